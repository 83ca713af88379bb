"""Whole evaluations: features fitted in each fold, thresholds from validation rows, grades of test rows.

What a fold learns is a table of parameters with the fold's key: word vectors, inverse document frequencies, thresholds. All
folds go through the same jobs; only these parameters, of a size that does not grow with the rows, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators import metrics, thresholds
from logsift.operators.ranks import shuffled_rank
from logsift.operators.training import Words, fit_words
from logsift.session import materialize

#: Rows of a task that makes features, about.
FEATURE_ROWS = 50_000


@dataclass
class FoldFeatures:
    """Parameters by fold: vectors (group, term, dim, v) and weights (fold, term, idf) of training rows."""

    vectors: DataFrame
    weights: DataFrame

    def tables(self) -> dict:
        """For each fold its words, their vectors and their weights; the driver holds vocabularies."""
        out, weights = {}, {(r["fold"], r["term"]): r["idf"] for r in self.weights.collect()}
        for r in self.vectors.orderBy("group", "term", "dim").collect():
            out.setdefault(r["group"], {}).setdefault(r["term"], []).append(r["v"])
        return {f: (list(t), np.array(list(t.values())), np.array([weights.get((f, w), 1.0) for w in t])) for f, t in out.items()}

    def transform(self, rows: DataFrame, kind: str = "mean_max") -> DataFrame:
        """rows (fold, events, ...) with x, n_tokens and n_oov instead of events.

        x is the mean of the vectors of the known words, with kind ``mean_max`` followed by their greatest components, with
        ``idf`` weighted (by nothing where weights do not add up to more than 0), scaled to length 1; without a known word it is 0.
        """
        held = rows.sparkSession.sparkContext.broadcast(self.tables())
        kept = [c for c in rows.columns if c != "events"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                folds, events = np.array(b.column("fold").to_pylist()), b.column("events")
                dims = next((v.shape[1] for _, v, _ in held.value.values()), 0)
                x = np.zeros((len(b), 2 * dims if kind == "mean_max" else dims))
                sizes = pc.fill_null(pc.list_value_length(events), 0).to_numpy().astype(np.int64)
                oov = sizes.copy()
                for f, (terms, vectors, weights) in held.value.items():
                    mine = np.flatnonzero(folds == f)
                    at = pc.index_in(events.take(pa.array(mine)).flatten(), pa.array(terms)).fill_null(-1).to_numpy()
                    row = np.repeat(np.arange(len(mine)), sizes[mine])[at >= 0]
                    at = at[at >= 0]
                    if len(at):
                        x[mine], known = pooled(vectors, weights, at, row, len(mine), kind)
                        oov[mine] -= known
                columns = [*[b.column(c) for c in kept], pa.array(list(x), pa.list_(pa.float64())), pa.array(sizes), pa.array(oov)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "x", "n_tokens", "n_oov"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "events")
        return rows.mapInArrow(run, f"{fields}, x array<double>, n_tokens long, n_oov long")


def spread(rows: DataFrame, key: str = "seq_id") -> DataFrame:
    """A materialized table dealt to all cores, in parts of FEATURE_ROWS at most: its file is small beside the work that
    features are, so that by its bytes a task would get hundreds of thousands of rows."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.table_rows // FEATURE_ROWS)), key)


def pooled(vectors: np.ndarray, weights: np.ndarray, at: np.ndarray, row: np.ndarray, n: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, known words) of n rows, from the words ``at`` that stand in rows ``row`` (ascending)."""
    known = np.bincount(row, minlength=n)
    total = np.zeros((n, vectors.shape[1]))
    if kind == "idf":
        w = np.bincount(row, weights[at], minlength=n)
        use = np.where(w[row] > 0, weights[at], 1.0)
        np.add.at(total, row, vectors[at] * use[:, None])
        total /= np.where(w > 0, w, np.maximum(known, 1))[:, None]
    else:
        np.add.at(total, row, vectors[at])
        total /= np.maximum(known, 1)[:, None]
    if kind == "mean_max":
        most, first = np.full_like(total, -np.inf), np.flatnonzero(np.diff(row, prepend=-1))
        most[row[first]] = np.maximum.reduceat(vectors[at], first, axis=0)
        total = np.concatenate([total, np.where(known[:, None] > 0, most, 0.0)], 1)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(length == 0, 1.0, length)), known


def fit_features(rows: DataFrame, words: Words | None = None) -> FoldFeatures:
    """From training rows (fold, seq_id, events): vectors of each fold's words, and ln(n / (1 + rows with the word))."""
    n = rows.groupBy("fold").agg(F.count("*").alias("n"))
    df = rows.select("fold", "seq_id", F.explode(F.array_distinct("events")).alias("term")).groupBy("fold", "term").agg(F.count("*").alias("df"))
    weights = df.join(F.broadcast(n), "fold").select("fold", "term", F.ln(F.col("n") / (1 + F.col("df"))).alias("idf"))  # a row for each fold
    return FoldFeatures(fit_words(rows, words, "fold"), weights)


def grades(scores: DataFrame, by: list[str], seed: int = 42, tail: thresholds.Tail | None = None, drawn: bool = True) -> DataFrame:
    """For each group of scores (by, seq_id, role, y, err), mode (A: peaks over threshold on validation normals; B: best F1 on
    validation rows) and view of the test rows (natural; balanced: all anomalies and as many normals, by seeded hash; not
    drawn: on all rows, see evened()): theta,
    fallback, the confusion, precision, recall and f1, and average_precision and roc_auc of the natural view.

    Thresholds see validation rows only, test rows are graded once. scores must be materialized. Groups, a fold or a
    model each, come to the driver as rows of parameters.
    """
    spark = scores.sparkSession
    val, test = scores.where("role = 'val'"), scores.where("role = 'test'")
    a = thresholds.mode_a_by(val.where("y = 0"), by, tail).assign(mode="A")
    b = thresholds.mode_b_by(val, by).assign(mode="B", fallback=False)
    cuts = spark.createDataFrame(pd_rows(a, by) + pd_rows(b, by), f"{', '.join(f'`{c}` {scores.schema[c].dataType.simpleString()}' for c in by)}, theta double, fallback boolean, mode string")
    cut = [*by, "mode", "view", "theta", "fallback"]
    flag = (F.col("err") > F.col("theta")).cast("int")
    ranks = metrics.average_precision(test, by=by).join(metrics.roc_auc(test, by=by), by)
    if not drawn:
        cells = metrics.confusion(test.join(F.broadcast(cuts), by).withColumns({"flag": flag, "view": F.lit("natural")}), cut)  # two rows for each group
        return metrics.precision_recall(evened(cells)).join(F.broadcast(materialize(ranks)), by)  # a row for each group
    odd = test.where("y = 1").groupBy(*by).agg(F.count("*").alias("n_odd"))
    ranked = shuffled_rank(test.where("y = 0"), seed, ["seq_id"], by).join(F.broadcast(odd), by, "left")  # a row for each group
    inside = ranked.withColumn("even", F.col("rn") <= F.coalesce("n_odd", F.lit(0))).drop("rn", "n_odd")
    graded = inside.unionByName(test.where("y = 1").withColumn("even", F.lit(True))).join(F.broadcast(cuts), by)  # two rows for each group
    views = graded.withColumn("flag", flag).withColumn("view", F.explode(F.when(F.col("even"), F.array(F.lit("natural"), F.lit("balanced"))).otherwise(F.array(F.lit("natural")))))
    cells = metrics.precision_recall(metrics.confusion(views, cut))
    return cells.join(F.broadcast(materialize(ranks)), by)  # a row for each group


def evened(cells: DataFrame) -> DataFrame:
    """cells of the natural view, and of a balanced one where there are anomalies: all anomalies, and of flagged and other normals so many, rounded, as
    samples of as many normals (all, if there are fewer) have on average."""
    odd, normal, even = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn"), F.col("view") == "balanced"
    most = F.least(odd, normal)
    fp = F.round(F.col("fp") * most / F.greatest(normal, F.lit(1))).cast("long")
    views = cells.withColumn("view", F.explode(F.when(odd > 0, F.array(F.lit("natural"), F.lit("balanced"))).otherwise(F.array(F.lit("natural")))))
    return views.withColumns({"fp": F.when(even, fp).otherwise(F.col("fp")), "tn": F.when(even, most - fp).otherwise(F.col("tn"))})


def pd_rows(frame, by: list[str]) -> list[tuple]:  # noqa: ANN001
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return [tuple(plain(v) for v in r) for r in frame[[*by, "theta", "fallback", "mode"]].itertuples(index=False)]
