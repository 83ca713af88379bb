"""Models, ensembles and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.parsing import soft_threshold
from logsift.operators import evaluation, features, metrics, models, persistence, sequences, splits, thresholds, training
from logsift.operators.ranks import quantiles_by
from logsift.plans.registry import query, r6
from logsift.plans.relational import CELLS_SQL, MINED_SQL, POS_SQL, cells, content
from logsift.session import materialize, shared_dir
from logsift.streaming import stateful, windows
from logsift.views import EVENTS_SQL, SCORED_SQL, as_log, log_events, scored, session_labels, vec64

#: Rows that forests draw theirs from, at most: as many as the 100 samples of 256 rows that the method itself draws.
FOREST_ROWS = 25_600

# --- the flagship: event counts, unit length, residual against a fixed subspace, top 5 % -----------------------

VOCAB6_SQL = "h AS (SELECT term FROM (SELECT DISTINCT term FROM c) ORDER BY CAST(regexp_extract(term, '([0-9]+)$', 1) AS INT), term LIMIT 6)"
RESIDUAL_SQL = f"""{CELLS_SQL}, {VOCAB6_SQL}, q AS (SELECT seq_id, sum(value * value) AS whole, sum(value * value) FILTER (term NOT IN (SELECT term FROM h)) AS rest FROM c GROUP BY seq_id),
p AS (SELECT seq_id, round(sqrt(coalesce(rest, 0) / whole::DOUBLE), 6) AS err FROM q)"""


def session_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Residual of unit count vectors against the span of the first six events: the length of all other parts."""
    held = cells(spark, d)
    first = features.natural_vocabulary(held, "term").where("col_idx < 6").select(F.col("event_id").alias("term"), F.lit(True).alias("held"))
    parts = features.l2_normalized(held).join(F.broadcast(first), "term", "left")  # six rows
    rest = F.coalesce(F.sum(F.when(F.col("held").isNull(), F.col("value") * F.col("value"))), F.lit(0.0))
    return parts.groupBy("seq_id").agg(r6(F.sqrt(rest)).alias("err"))


@query("model_projection_residual", f"WITH {RESIDUAL_SQL} SELECT seq_id, err FROM p")
def model_projection_residual(spark: SparkSession, d: str) -> DataFrame:
    return session_residuals(spark, d)


@query("entry_session_detector", f"""WITH {RESIDUAL_SQL}, y AS (SELECT seq_id, max(y) AS y FROM s GROUP BY seq_id),
g AS (SELECT y, CASE WHEN row_number() OVER (ORDER BY err DESC, seq_id) <= ceil(0.05 * count(*) OVER ()) THEN 1 ELSE 0 END AS flag FROM p JOIN y USING (seq_id)),
m AS (SELECT count(*) FILTER (flag = 1 AND y = 1) AS tp, count(*) FILTER (flag = 1 AND y = 0) AS fp, count(*) FILTER (flag = 0 AND y = 1) AS fn, count(*) FILTER (flag = 0 AND y = 0) AS tn FROM g)
SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM m""")
def entry_session_detector(spark: SparkSession, d: str) -> DataFrame:
    rows = session_residuals(spark, d).join(session_labels(spark, d), "seq_id")
    found = metrics.precision_recall(metrics.confusion(thresholds.top_fraction(rows)))
    return found.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


# --- scalar and relational parts of models ---------------------------------------------------------------------


@query("fn_soft_threshold", f"WITH {SCORED_SQL} SELECT seq_id, round(sign(err - 60) * greatest(abs(err - 60) - 20, 0), 6) + 0 AS v FROM r")
def fn_soft_threshold(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("seq_id", r6(soft_threshold(F.col("err") - 60, 20.0)).alias("v"))


@query("model_zscore_ensemble", f"""WITH {SCORED_SQL}, m AS (SELECT seq_id, role, unnest(['a', 'b', 'c']) AS model, unnest([err, sqrt(err), err * err]) AS err FROM r),
t AS (SELECT model, avg(err) AS mu, stddev_pop(err) AS sigma FROM m WHERE role = 'fit' GROUP BY model) SELECT seq_id, round(avg((err - mu) / (sigma + 1e-10)), 5) + 0 AS err FROM m JOIN t USING (model) GROUP BY seq_id""")
def model_zscore_ensemble(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("err")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), v.alias("err")) for n, v in (("a", e), ("b", F.sqrt(e)), ("c", e * e))])).alias("m")
    long = scored(spark, d).select("seq_id", "role", each).select("seq_id", "role", "m.*")
    stats = long.where("role = 'fit'").groupBy("model").agg(F.avg("err").alias("mu"), F.stddev_pop("err").alias("sigma"))
    return models.zscore_ensemble(long, stats).select("seq_id", (F.round("err", 5) + F.lit(0.0)).alias("err"))


@query("model_dynamic_k", f"""WITH {POS_SQL}, v AS (SELECT k, sum(v * v) AS energy FROM x GROUP BY k),
c AS (SELECT row_number() OVER (ORDER BY energy DESC) AS i, sum(energy) OVER (ORDER BY energy DESC ROWS UNBOUNDED PRECEDING) / sum(energy) OVER () AS share FROM v)
SELECT CAST(least(min(i) FILTER (share >= 0.5), 40) AS BIGINT) AS k FROM c""")
def model_dynamic_k(spark: SparkSession, d: str) -> DataFrame:
    """The rank rule on the energies of the coordinates themselves."""
    by = vec64(spark, d).select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))
    energy = np.array(sorted((r["energy"] for r in by.collect()), reverse=True))  # a number for each dimension
    return spark.createDataFrame([(models.smallest_rank(energy, 0.5, 40),)], "k long")


IN, HIDDEN = 8, 4


def _weight(i: int, j: int) -> float:
    return ((i * 3 + j * 5) % 7 - 3) / 10


@query("model_mlp_forward", f"""WITH {POS_SQL}, i AS (SELECT * FROM x WHERE k < {IN}),
h AS (SELECT seq_id, j, greatest(sum(v * (((k * 3 + j * 5) % 7 - 3) / 10e0)) + j / 100e0, 0) AS z FROM i, range({HIDDEN}) AS q(j) GROUP BY seq_id, j),
o AS (SELECT seq_id, k2, sum(z * (((j * 3 + k2 * 5) % 7 - 3) / 10e0)) + k2 / 100e0 AS u FROM h, range({IN}) AS q(k2) GROUP BY seq_id, k2)
SELECT o.seq_id, round(sqrt(sum((v - u) * (v - u))), 5) AS err FROM o JOIN i ON i.seq_id = o.seq_id AND i.k = o.k2 GROUP BY o.seq_id""")
def model_mlp_forward(spark: SparkSession, d: str) -> DataFrame:
    first = np.array([[_weight(i, j) for j in range(HIDDEN)] for i in range(IN)])
    second = np.array([[_weight(j, k) for k in range(IN)] for j in range(HIDDEN)])
    net = models.Network(np.zeros(IN), [(first, np.arange(HIDDEN) / 100), (second, np.arange(IN) / 100)])
    rows = vec64(spark, d).select("seq_id", F.slice("x", 1, IN).alias("x"))
    return rows.select("seq_id", F.round(features.norm(features.minus(F.col("x"), net.forward(F.col("x")))), 5).alias("err"))


# --- fitted models -----------------------------------------------------------------------------------------------


def normals(spark: SparkSession, d: str) -> DataFrame:
    return vec64(spark, d).where("y = 0 AND seq_id % 5 <> 0")


def held_rows(spark: SparkSession, d: str) -> DataFrame:
    return vec64(spark, d).where("y = 1 OR seq_id % 5 = 0")


def rounded(rows: DataFrame, digits: int = 4) -> DataFrame:
    return rows.select("seq_id", "y", F.round("err", digits).alias("err"))


@query("model_pca_score")
def model_pca_score(spark: SparkSession, d: str) -> DataFrame:
    space = models.fit_pca(normals(spark, d), 6)
    return rounded(held_rows(spark, d).withColumn("err", space.residual(F.col("x"))))


@query("sink_model_roundtrip", "SELECT vec_id AS seq_id, true AS same FROM embeddings WHERE label = 9 OR vec_id % 5 = 0")
def sink_model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether a subspace that was saved and loaded again scores each held row as the fitted one does."""
    fitted, path = models.fit_pca(normals(spark, d), 6), f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    persistence.save(spark, fitted, path)
    loaded = persistence.load(spark, path)
    rows = held_rows(spark, d)
    return rows.select("seq_id", (F.abs(fitted.residual(F.col("x")) - loaded.residual(F.col("x"))) < 1e-9).alias("same"))


@query("model_explained_variance")
def model_explained_variance(spark: SparkSession, d: str) -> DataFrame:
    energy = models.fit_pca(normals(spark, d), 1).energy
    share = np.cumsum(energy) / energy.sum()
    return spark.createDataFrame([(k + 1, round(float(s), 6)) for k, s in enumerate(share)], "k long, share double")


FOLDS = 5


def fold_roles(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified(vec64(spark, d).select("seq_id", "y"), FOLDS, 42, ["seq_id"])


@query("eval_pca_folds")
def eval_pca_folds(spark: SparkSession, d: str) -> DataFrame:
    """A whole evaluation: in each fold a subspace is fitted on training normals, its threshold set on validation normals
    (mode A), and all test rows are flagged and graded. All folds go through the same jobs."""
    rows = materialize(vec64(spark, d).select("seq_id", "x").join(fold_roles(spark, d), "seq_id").where("role <> 'unused'"))
    spaces = models.fit_pca_by(rows.where("role = 'train'"), "fold", 6)
    scores = materialize(models.residuals_by(rows.where("role <> 'train'"), spaces, "fold").drop("x"))
    found = evaluation.grades(scores, ["fold"]).where("mode = 'A' AND view = 'natural'")
    measures = ("precision", "recall", "f1", "average_precision", "roc_auc")
    return found.select("fold", *metrics.CELLS, *[r6(c).alias(c) for c in measures], "fallback")


@query("model_rpca")
def model_rpca(spark: SparkSession, d: str) -> DataFrame:
    found = models.robust_pca_rows(normals(spark, d))
    row = (found.iterations, found.rank, round(found.error, 9), found.sparse_cells())
    return spark.createDataFrame([row], "iterations long, rank long, error double, sparse_cells long")


@query("model_rpca_score")
def model_rpca_score(spark: SparkSession, d: str) -> DataFrame:
    space = models.fit_rpca_rows(normals(spark, d), 9)
    return rounded(held_rows(spark, d).withColumn("err", space.residual(F.col("x"))))


def _f1(rows: DataFrame, by: str, q: float = 0.95) -> DataFrame:
    """(by, f1) of rows (by, y, err): those above the q-quantile of their group are flagged, which are counted by rank."""
    found = quantiles_by(rows, "err", [q], [by], thresholds.LABELS)
    f1 = [(int(r[0]), thresholds.best_f1(found.iloc[[i]])[1]) for i, r in enumerate(found[[by]].itertuples(index=False))]
    return rows.sparkSession.createDataFrame(f1, f"{by} int, f1 double")


def _graded(spark: SparkSession, d: str, score: Callable[[int, np.ndarray], np.ndarray], configs: list[dict], schema: str, digits: int) -> DataFrame:
    """Configurations with their f1 over all held rows; score takes a configuration's number and a matrix."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.array(b.x.tolist(), float)
            for i in range(len(configs) if len(b) else 0):
                yield pd.DataFrame({"config": i, "y": b.y, "err": score(i, m)})

    found = _f1(held_rows(spark, d).select("y", "x").mapInPandas(run, "config int, y int, err double"), "config")
    named = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(configs)], f"config int, {schema}")
    return named.join(F.broadcast(found), "config").select(*configs[0], F.round("f1", digits).alias("f1"))  # a row for each


@query("model_rpca_grid")
def model_rpca_grid(spark: SparkSession, d: str) -> DataFrame:
    """Fits of two sizes, which the grid is to compare; scores are of all held rows."""
    fit = models.sample(normals(spark, d), 1000)

    def work(c: dict) -> dict:
        space = models.fit_rpca(fit[: c["rows"]], 9, c["scale"], c["center"])
        return c | {"mean": space.mean.tolist(), "basis": space.basis.tolist()}

    grid = [{"scale": s, "center": c, "rows": n} for s in (0.8, 1.0, 1.2) for c in (False, True) for n in (250, 500)]
    made = models.run_grid(spark, grid, work, "scale double, center boolean, rows long, mean array<double>, basis array<array<double>>").collect()
    spaces = {(r["scale"], r["center"], r["rows"]): (np.array(r["mean"]), np.array(r["basis"])) for r in made}
    ordered = [spaces[tuple(c.values())] for c in grid]

    def residual(i: int, m: np.ndarray) -> np.ndarray:
        mean, basis = ordered[i]
        z = m - mean
        return np.linalg.norm(z - z @ basis.T @ basis, axis=1)

    return _graded(spark, d, residual, grid, "scale double, center boolean, rows long", 6)


@query("model_rpca_transductive")
def model_rpca_transductive(spark: SparkSession, d: str) -> DataFrame:
    """Held rows themselves decomposed: a row scores by its sparse part, or by what the low-rank part's directions leave of it."""
    found = models.robust_pca_rows(held_rows(spark, d))
    each = {"sparse": found.sparse_norms(), "subspace": found.low_residuals()}
    sparse, subspace = (rounded(rows).select("seq_id", "y", F.lit(name).alias("score"), "err") for name, rows in each.items())
    return sparse.unionByName(subspace)


@query("model_ae_score")
def model_ae_score(spark: SparkSession, d: str) -> DataFrame:
    nets = training.fit_networks(normals(spark, d), [training.Setup()])
    return rounded(training.score_networks(held_rows(spark, d), nets))


SEEDS = (42, 43, 44, 45, 46)


@query("model_seed_ensemble")
def model_seed_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Networks of five seeds, fitted in the same jobs; a row's score is the mean of theirs, taken in its task."""
    nets = training.fit_networks(normals(spark, d), [training.Setup(seed=s) for s in SEEDS])
    return rounded(training.score_networks(held_rows(spark, d), nets))


@query("eval_seeds")
def eval_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Grades of each seed's network and of their mean, thresholds from validation rows: seed 0 is the ensemble."""
    rows = materialize(vec64(spark, d).select("seq_id", "x").join(fold_roles(spark, d).where("fold = 1 AND role <> 'unused'").drop("fold"), "seq_id"))
    nets = training.fit_networks(rows.where("role = 'train'"), [training.Setup(seed=s) for s in SEEDS])[0]
    held = spark.sparkContext.broadcast(nets)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                errs = np.array([n.errors(np.array(b.x.tolist(), float)) for n in held.value])
                for seed, err in zip((0, *SEEDS), (errs.mean(0), *errs), strict=True):
                    yield pd.DataFrame({"seed": seed, "seq_id": b.seq_id, "role": b.role, "y": b.y, "err": err})

    scores = materialize(rows.where("role <> 'train'").mapInPandas(each, "seed long, seq_id long, role string, y int, err double"))
    found = evaluation.grades(scores, ["seed"]).where("view = 'natural'")
    return found.select("seed", "mode", "fallback", *metrics.CELLS, *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "average_precision", "roc_auc")])


@query("model_iforest")
def model_iforest(spark: SparkSession, d: str) -> DataFrame:
    forest = models.fit_forest(models.sample(normals(spark, d), FOREST_ROWS))
    return rounded(models.score_batches(held_rows(spark, d), forest.scores))


@query("model_hybrid")
def model_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Second stages fitted on what robust decomposition leaves of all training rows."""
    found = models.robust_pca_rows(normals(spark, d), center=True)
    low, mean = materialize(found.low_rows()), found.mean
    net = training.fit_networks(low, [training.Setup((16, 8, 16))])[0][0]
    fitted = {"forest": models.fit_forest(models.sample(low, FOREST_ROWS)).scores, "one_class": training.fit_one_class_rows(low).scores, "autoencoder": net.errors}
    out = None
    for name, m in fitted.items():
        rows = models.score_batches(held_rows(spark, d), lambda z, m=m: m(z - mean)).select("seq_id", F.lit(name).alias("model"), F.round("err", 4).alias("err"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("sel_pca_k")
def sel_pca_k(spark: SparkSession, d: str) -> DataFrame:
    """F1 of each number of directions on validation rows, with mode A's threshold from validation normals, and the first best.
    One decomposition of the training normals of the first fold, and one product for each row, serve all of them."""
    ks = [2, 4, 6, 8, 12, 16, 20, 24, 32, 48]
    rows = vec64(spark, d).select("seq_id", "x").join(fold_roles(spark, d).where("fold = 1 AND role IN ('train', 'val')"), "seq_id")
    rows = materialize(rows)
    spaces = models.fit_pca_by(rows.where("role = 'train'"), "fold", 64)
    errs = models.residuals_by(rows.where("role = 'val'"), spaces, "fold", ks)
    scores = materialize(errs.select("y", F.posexplode("err").alias("place", "err")))
    cuts = spark.createDataFrame(thresholds.mode_a_by(scores.where("y = 0"), ["place"])).drop("fallback")
    flags = scores.join(F.broadcast(cuts), "place").withColumn("flag", (F.col("err") > F.col("theta")).cast("int"))  # a row for each k
    found = {r["place"]: r["f1"] for r in metrics.precision_recall(metrics.confusion(flags, ["place"])).collect()}
    best = max(found, key=lambda i: (found[i], -i)) if found else None
    return spark.createDataFrame([(ks[i], round(f1, 6), i == best) for i, f1 in found.items()], "k long, f1 double, chosen boolean")


@query("diag_k_sweep")
def diag_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    """F1 of k directions of plain and of robust decomposition over all held rows, and how the robust one ended."""
    plain = models.fit_pca(normals(spark, d), 15)
    found = models.robust_pca_rows(normals(spark, d))
    values, vectors = np.linalg.eigh(found.gram_of_low())
    robust = models.Subspace(found.mean, vectors[:, np.argsort(values)[::-1][:15]].T, np.sort(values)[::-1])
    grid = [{"method": m, "k": k} for m in ("pca", "rpca") for k in range(2, 16)]

    def residual(i: int, m: np.ndarray) -> np.ndarray:
        space = plain if grid[i]["method"] == "pca" else robust
        z, basis = m - space.mean, space.basis[: grid[i]["k"]]
        return np.linalg.norm(z - z @ basis.T @ basis, axis=1)

    swept = _graded(spark, d, residual, grid, "method string, k long", 6)
    cells = found.sparse_cells()
    share = cells / (normals(spark, d).count() * len(found.mean))
    values = {"iterations": F.lit(found.iterations).cast("long"), "converged": F.lit(found.error < 1e-7), "sparse_cells": F.lit(cells).cast("long"), "sparse_share": F.lit(round(share, 6)), "final_error": F.lit(round(found.error, 9))}
    return swept.withColumns(values)


@query("sel_variant_grid")
def sel_variant_grid(spark: SparkSession, d: str) -> DataFrame:
    """Networks of all variants, fitted on all rows in the same jobs, and graded on all held rows."""
    grid = [{"hidden": h, "alpha": a, "seed": s} for h in ((16, 8, 16), (32, 16, 32)) for a in (1e-4, 1e-2) for s in (42, 43)]
    nets = training.fit_networks(normals(spark, d), [training.Setup(c["hidden"], c["alpha"], c["seed"], epochs=20) for c in grid])[0]
    named = [{"hidden": "-".join(map(str, c["hidden"])), "alpha": c["alpha"], "seed": c["seed"]} for c in grid]
    return _graded(spark, d, lambda i, m: nets[i].errors(m), named, "hidden string, alpha double, seed long", 4)


# --- word vectors and evaluations with features fitted in each fold ------------------------------------------------


def node_weeks(spark: SparkSession, d: str) -> DataFrame:
    """(seq_id, start_s, events, y): the lines of a node in a week."""
    lines = sequences.tumbling(log_events(spark, d), 604_800).withColumn("seq_id", F.col("node") * 10_000 + F.col("window_id"))
    return sequences.collect_sequences(lines, ["seq_id"], ["ts_s", "line_id"]).join(lines.groupBy("seq_id").agg(F.min("ts_s").alias("start_s"), F.max("y").alias("y")), "seq_id")


@query("feat_w2v_fit")
def feat_w2v_fit(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all words of all sequences: skip-gram with negative sampling."""
    return training.fit_words(node_weeks(spark, d)).select(F.col("term").alias("word"), "dim", r6("v").alias("v"))


@query("feat_w2v_pool")
def feat_w2v_pool(spark: SparkSession, d: str) -> DataFrame:
    """Mean and greatest of fitted vectors, of unit length, for each sequence."""
    rows = node_weeks(spark, d).withColumn("fold", F.lit(0))
    found = evaluation.fit_features(rows).transform(rows.select("fold", "seq_id", "events"))
    return found.select("seq_id", F.transform("x", lambda v: F.round(v, 6) + F.lit(0.0)).alias("x"), "n_tokens", "n_oov")


MEASURES = ("precision", "recall", "f1", "average_precision", "roc_auc")


def _evaluated(rows: DataFrame, by: list[str], drawn: bool = True) -> DataFrame:
    """Grades of two models by fold, over rows (fold, seq_id, role, y, events): vectors, means and models know training rows only. drawn: whether
    the balanced view draws normals."""
    rows = materialize(rows.where("role <> 'unused'"))
    made = evaluation.fit_features(rows.where("role = 'train'"), training.Words(epochs=2))
    x = materialize(made.transform(evaluation.spread(rows)))
    train, rest = x.where("role = 'train'"), x.where("role <> 'train'")
    nets = training.fit_networks(train, [training.Setup(epochs=30)], "fold")
    scored_ = [("autoencoder", training.score_networks(rest, nets, "fold")), ("pca", models.residuals_by(rest, models.fit_pca_by(train, "fold", 6), "fold"))]
    each = [s.select(F.lit(m).alias("model"), "fold", "seq_id", "role", "y", "err") for m, s in scored_]
    found = evaluation.grades(materialize(each[0].unionByName(each[1])), ["model", "fold"], drawn=drawn)
    oov = x.where("role = 'test'").groupBy("fold").agg((F.sum("n_oov") / F.sum("n_tokens")).alias("oov"))
    found = found.join(F.broadcast(materialize(oov)), "fold")  # a row for each fold
    return found.select("model", *by, "mode", "view", "fallback", *metrics.CELLS, *[F.round(c, 4).alias(c) for c in MEASURES], r6("oov").alias("oov"))


@query("eval_folds")
def eval_folds(spark: SparkSession, d: str) -> DataFrame:
    """Ten folds, modes A and B, natural and balanced views; features are fitted in each fold."""
    seqs = materialize(node_weeks(spark, d))
    roles = splits.stratified(seqs.select("seq_id", "y"), 10, 42, ["seq_id"])
    return _evaluated(roles.join(seqs.select("seq_id", "events"), "seq_id"), ["fold"])


@query("eval_chronological")
def eval_chronological(spark: SparkSession, d: str) -> DataFrame:
    """The first 70 % of the normals in time train, 10 % and all earlier anomalies validate, the rest test. All rows have their part; the balanced view
    weighs all normals instead of drawing some."""
    seqs = materialize(node_weeks(spark, d))
    roles = splits.chronological(seqs.select("seq_id", "y", "start_s"), ["seq_id"], "start_s").withColumn("fold", F.lit(0))
    return _evaluated(roles.join(seqs.select("seq_id", "events"), "seq_id"), [], drawn=False)


# --- streams -----------------------------------------------------------------------------------------------------


def event_windows(spark: SparkSession, d: str, name: str, window: Column, keys: list[str]) -> DataFrame:
    y = (F.col("value") > 200).cast("int")
    held = lambda events: windows.windowed(events, window, keys, [F.count("*").alias("n_events"), F.max(y).alias("y")])
    return windows.drain_windows(spark, f"{d}/events.parquet", "10 minutes", name, held)


@query("stream_node_6h", f"WITH {EVENTS_SQL} SELECT node, CAST(floor(ts_s / 21600) AS BIGINT) AS window_id, count(*) AS n_events, max(y) AS y FROM e GROUP BY ALL")
def stream_node_6h(spark: SparkSession, d: str) -> DataFrame:
    start = F.unix_timestamp(F.col("w.start"))
    return event_windows(spark, d, "node6h", F.window("ts", "6 hours"), ["user_id"]).select(F.col("user_id").alias("node"), F.floor(start / 21600).alias("window_id"), "n_events", "y")


@query("stream_sliding", f"WITH {EVENTS_SQL}, w AS (SELECT CAST(floor(ts_s / 3600) AS BIGINT) - unnest(range(6)) AS hour, y FROM e) SELECT hour, count(*) AS n_events, max(y) AS y FROM w GROUP BY hour")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    held = event_windows(spark, d, "sliding", F.window("ts", "6 hours", "1 hour"), [])
    return held.select(F.floor(F.unix_timestamp(F.col("w.start")) / 3600).alias("hour"), "n_events", "y")


@query("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id AS node, count(*) AS n_events, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s FROM s GROUP BY user_id, n""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    held = event_windows(spark, d, "session", F.session_window("ts", "12 hours"), ["user_id"])
    return held.select(F.col("user_id").alias("node"), "n_events", F.unix_timestamp(F.col("w.start")).alias("start_s"))


@query("stream_fixed_count", f"WITH {EVENTS_SQL}, f AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY ts_s, line_id) - 1) // 10 AS window_no FROM e) SELECT node, window_no, count(*) AS n, max(y) AS y FROM f GROUP BY ALL")
def stream_fixed_count(spark: SparkSession, d: str) -> DataFrame:
    held = lambda e: stateful.fixed_count(as_log(e).withColumnRenamed("line_id", "id"), 10, "node", "300 days")
    return windows.drain_windows(spark, f"{d}/events.parquet", "10 minutes", "fixed", held)


@query("stream_drain", MINED_SQL)
def stream_drain(spark: SparkSession, d: str) -> DataFrame:
    """Templates as the stream leaves them: the last of each cluster."""
    lines = as_log(windows.with_time(windows.stream_table(spark, f"{d}/events.parquet"), "10 minutes"))
    found = windows.drain(stateful.online_templates(lines.select("line_id", "ts", content().alias("content"))), "drain")
    last = found.groupBy("cluster").agg(F.max_by("template", "line_id").alias("template"), F.count("*").alias("n"))
    return last.select(F.substring(F.md5("template"), 1, 8).alias("template_id"), "template", "cluster", "n")


@query("stream_alerts", "SELECT event_id, user_id AS node FROM events WHERE value * 2e0 > 300")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    params = spark.createDataFrame([(1, 2.0, 300.0)], "model int, factor double, theta double")
    scores = windows.stream_table(spark, f"{d}/events.parquet").withColumn("model", F.lit(1)).join(F.broadcast(params), "model")  # one row
    alerts = scores.where(F.col("value") * F.col("factor") > F.col("theta")).select("event_id", F.col("user_id").alias("node"))
    return windows.drain(alerts, "alerts")
