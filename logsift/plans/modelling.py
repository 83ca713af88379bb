"""Features, splits, thresholds and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators import features, metrics, sequences, splits, thresholds
from logsift.operators.ranks import shuffled_rank
from logsift.plans.registry import one_row, query, r6
from logsift.plans.relational import BIGRAM_SQL, CELLS_SQL, POS_SQL, cells, key_sql, rank_sql, session_bigrams, vocabulary
from logsift.session import in_parts
from logsift.views import EVENTS_SQL, SCORED_SQL, SESSIONS_SQL, SIX_HOURS, log_events, log_sessions, scored, session_labels, table, vec64

# --- features ------------------------------------------------------------------------------------------------


def rounded(long: DataFrame) -> DataFrame:
    return long.select("seq_id", "term", r6("value").alias("value"))


@query("feat_count_vector", f"WITH {CELLS_SQL}, v AS (SELECT term, row_number() OVER (ORDER BY CAST(regexp_extract(term, '([0-9]+)$', 1) AS INT), term) - 1 AS col_idx FROM (SELECT DISTINCT term FROM c)) SELECT seq_id, col_idx, value FROM c JOIN v USING (term)")
def feat_count_vector(spark: SparkSession, d: str) -> DataFrame:
    lines = log_sessions(spark, d)
    vocab = features.natural_vocabulary(lines).withColumnRenamed("event_id", "term")
    return features.counts(lines).join(vocab, "term").select("seq_id", "col_idx", "value")


@query("feat_l2_normalize", f"WITH {CELLS_SQL} SELECT seq_id, term, round(value / sqrt(sum(value * value) OVER (PARTITION BY seq_id)), 6) AS value FROM c")
def feat_l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.l2_normalized(cells(spark, d)))


TFIDF_SQL = f"""{CELLS_SQL}, i AS (SELECT term, ln((SELECT n FROM n) / (1e0 + count(*))) AS idf FROM c GROUP BY term),
t AS (SELECT seq_id, term, value / sum(value) OVER (PARTITION BY seq_id) * idf AS value FROM c JOIN i USING (term))"""


def tf_idf(spark: SparkSession, d: str) -> DataFrame:
    held = cells(spark, d)
    return features.tf_idf(held, features.idf(held, held.select("seq_id").distinct().count()))


@query("feat_tfidf", f"WITH {TFIDF_SQL} SELECT seq_id, term, round(value, 6) + 0 AS value FROM t")
def feat_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tf_idf(spark, d))


@query("feat_tfidf_l2", f"WITH {TFIDF_SQL} SELECT seq_id, term, round(value / sqrt(sum(value * value) OVER (PARTITION BY seq_id)), 6) + 0 AS value FROM t")
def feat_tfidf_l2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.l2_normalized(tf_idf(spark, d)))


@query("feat_tfidf_fold", f"""WITH {CELLS_SQL}, f AS (SELECT * FROM c WHERE seq_id % 5 <> 0),
i AS (SELECT term, ln((SELECT count(DISTINCT seq_id) FROM f) / (1e0 + count(*))) AS idf FROM f GROUP BY term)
SELECT seq_id, term, round(value / tot * idf, 6) + 0 AS value FROM (SELECT *, sum(value) OVER (PARTITION BY seq_id) AS tot FROM c WHERE seq_id % 5 = 0) JOIN i USING (term)""")
def feat_tfidf_fold(spark: SparkSession, d: str) -> DataFrame:
    held = cells(spark, d)
    fit = held.where("seq_id % 5 <> 0")
    return rounded(features.tf_idf(held.where("seq_id % 5 = 0"), features.idf(fit, fit.select("seq_id").distinct().count())))


@query("feat_idf_smooth", f"WITH {CELLS_SQL} SELECT term, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1e0)) + 1, 6) AS idf FROM c, n GROUP BY term")
def feat_idf_smooth(spark: SparkSession, d: str) -> DataFrame:
    held = cells(spark, d)
    return features.idf(held, held.select("seq_id").distinct().count(), smooth=True).select("term", "df", r6("idf").alias("idf"))


@query("feat_bigram_l2", f"WITH {BIGRAM_SQL} SELECT seq_id, a || '->' || b AS term, round(n / sqrt(sum(n * n) OVER (PARTITION BY seq_id)), 6) AS value FROM b")
def feat_bigram_l2(spark: SparkSession, d: str) -> DataFrame:
    pairs = session_bigrams(spark, d).select("seq_id", F.concat_ws("->", "a", "b").alias("term"), F.col("n").alias("value"))
    return rounded(features.l2_normalized(pairs))


GAPS_SQL = f"""{SESSIONS_SQL}, q AS (SELECT seq_id, ts_s, lead(ts_s) OVER (PARTITION BY seq_id ORDER BY pos) - ts_s AS gap FROM s),
t AS (SELECT seq_id, coalesce(avg(gap), 0) AS gap_mean, coalesce(stddev_pop(gap), 0) AS gap_std, coalesce(max(gap), 0)::DOUBLE AS gap_max, (max(ts_s) - min(ts_s))::DOUBLE AS latency FROM q GROUP BY seq_id)"""
STATS = ("gap_mean", "gap_std", "gap_max", "latency")


@query("feat_time_stats", f"WITH {GAPS_SQL} SELECT seq_id, round(gap_mean, 3) + 0 AS gap_mean, round(gap_std, 3) + 0 AS gap_std, gap_max, latency FROM t")
def feat_time_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = features.interval_stats(log_sessions(spark, d), ["pos"])
    return rows.select("seq_id", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("gap_mean", "gap_std")], "gap_max", "latency")


@query("feat_combined", f"""WITH {GAPS_SQL}, c AS (SELECT seq_id, event_id AS term, count(*)::DOUBLE AS value FROM s GROUP BY ALL),
g AS (SELECT seq_id, event_id AS a, lead(event_id) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM s),
b AS (SELECT seq_id, a || '->' || b AS term, count(*)::DOUBLE AS value FROM g WHERE b IS NOT NULL GROUP BY ALL),
w AS (SELECT seq_id, unnest(['gap_mean', 'gap_std', 'gap_max', 'latency']) AS term, unnest([gap_mean, gap_std, gap_max, latency]) AS value FROM t),
m AS (SELECT term, CASE WHEN max(value) = 0 THEN 1 ELSE max(value) END AS most FROM w GROUP BY term),
u AS (SELECT * FROM c UNION ALL SELECT * FROM b UNION ALL SELECT seq_id, term, value / most FROM w JOIN m USING (term)),
l AS (SELECT seq_id, sqrt(sum(value * value)) AS norm FROM u GROUP BY seq_id)
SELECT seq_id, term, round(value / norm, 6) AS value FROM u JOIN l USING (seq_id) WHERE round(value / norm, 6) <> 0""")
def feat_combined(spark: SparkSession, d: str) -> DataFrame:
    lines = log_sessions(spark, d)
    pairs = session_bigrams(spark, d).select("seq_id", F.concat_ws("->", "a", "b").alias("term"), F.col("n").cast("double").alias("value"))
    stats = features.interval_stats(lines, ["pos"]).unpivot("seq_id", list(STATS), "term", "value")
    parts = features.counts(lines).select("seq_id", "term", F.col("value").cast("double")).unionByName(pairs)
    parts = parts.unionByName(features.column_scaled(stats, 1, "max").select("seq_id", "term", "value"))
    most = 3 * table(spark, d, "lineitem").count()  # a term and a pair for each line, four numbers for each session
    return rounded(features.l2_normalized(in_parts(parts, most, "seq_id"))).where("value <> 0")


@query("feat_center", f"WITH {POS_SQL}, m AS (SELECT k, avg(v) AS m FROM x GROUP BY k) SELECT seq_id, CAST(k AS INT) AS k, round(v - m, 6) + 0 AS v FROM x JOIN m USING (k)")
def feat_center(spark: SparkSession, d: str) -> DataFrame:
    rows = vec64(spark, d)
    mean = F.array(*[F.lit(m) for m in features.vector_mean(rows)])
    return rows.select("seq_id", F.posexplode(features.minus(F.col("x"), mean)).alias("k", "v")).select("seq_id", "k", r6("v").alias("v"))


#: Fixed token vectors of 8 dimensions, for templates of normal lines with an even k: sin((dim + 1) * n).
VECTORS_SQL = "t AS (SELECT event_id AS term, k2 AS dim, sin((k2 + 1) * n) AS v FROM (SELECT event_id, count(*) AS n FROM e WHERE y = 0 AND k % 2 = 0 GROUP BY event_id), range(8) AS q(k2))"
POOL_SQL = f"""{EVENTS_SQL}, {VECTORS_SQL}, i AS (SELECT event_id AS term, ln((SELECT count(*) FROM e) / (1e0 + count(*))) AS idf FROM e WHERE k % 3 <> 0 GROUP BY event_id),
p AS (SELECT node AS seq_id, dim, avg(v) AS mean, max(v) AS most, sum(coalesce(idf, 1) * v) / sum(coalesce(idf, 1)) AS weighted FROM e JOIN t ON e.event_id = t.term LEFT JOIN i ON i.term = e.event_id GROUP BY ALL)"""


def pools(spark: SparkSession, d: str) -> DataFrame:
    lines = log_events(spark, d)
    n = lines.count()
    vectors = vocabulary(spark, d).select(F.col("event_id").alias("term"), "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim"))
    vectors = vectors.select("term", "dim", F.sin((F.col("dim") + 1) * F.col("n")).alias("v"))
    idf = lines.where("k % 3 <> 0").groupBy(F.col("event_id").alias("term")).agg(F.ln(F.lit(n) / (1 + F.count("*"))).alias("idf"))
    return features.pooled(lines.select(F.col("node").alias("seq_id"), F.col("event_id").alias("term")), vectors, idf)


def _pool_sql(what: str) -> str:
    return f"WITH {POOL_SQL}, w AS (SELECT seq_id, dim, {what} AS v FROM p), l AS (SELECT seq_id, sqrt(sum(v * v)) AS norm FROM w GROUP BY seq_id) SELECT seq_id, CAST(dim AS INT) AS dim, round(v / norm, 5) + 0 AS value FROM w JOIN l USING (seq_id)"


def _pool(spark: SparkSession, d: str, what: str) -> DataFrame:
    rows = pools(spark, d).select("seq_id", F.col("dim").alias("term"), F.col(what).alias("value"))
    return features.l2_normalized(rows).select("seq_id", F.col("term").alias("dim"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query("feat_pool_mean", _pool_sql("mean"))
def feat_pool_mean(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d, "mean")


@query("feat_pool_idf", _pool_sql("weighted"))
def feat_pool_idf(spark: SparkSession, d: str) -> DataFrame:
    return _pool(spark, d, "weighted")


@query("feat_pool_mean_max", f"""WITH {POOL_SQL}, w AS (SELECT seq_id, dim, mean AS v FROM p UNION ALL SELECT seq_id, dim + 8, most FROM p),
l AS (SELECT seq_id, sqrt(sum(v * v)) AS norm FROM w GROUP BY seq_id) SELECT seq_id, CAST(dim AS INT) AS dim, round(v / norm, 5) + 0 AS value FROM w JOIN l USING (seq_id)""")
def feat_pool_mean_max(spark: SparkSession, d: str) -> DataFrame:
    held = pools(spark, d)
    both = held.select("seq_id", F.explode(F.array(F.struct(F.col("dim").alias("term"), F.col("mean").alias("value")), F.struct((F.col("dim") + 8).alias("term"), F.col("max").alias("value")))).alias("c"))
    return features.l2_normalized(both.select("seq_id", "c.*")).select("seq_id", F.col("term").alias("dim"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


# --- splits --------------------------------------------------------------------------------------------------


def ntile_sql(k: int, seed: object, by: str = "y") -> str:
    return f"ntile({k}) OVER (PARTITION BY {by} ORDER BY {key_sql(seed, 'seq_id')}, seq_id)"


@query("split_kfold", f"WITH {SCORED_SQL} SELECT seq_id, y, {ntile_sql(10, 42)} AS fold FROM r")
def split_kfold(spark: SparkSession, d: str) -> DataFrame:
    return splits.kfold(scored(spark, d).select("seq_id", "y"), 10, 42, ["seq_id"]).select("seq_id", "y", "fold")


@query("split_contiguous", f"WITH {SCORED_SQL} SELECT seq_id, CAST(floor(({rank_sql('slices')} - 1) / 500) AS BIGINT) AS slice FROM r")
def split_contiguous(spark: SparkSession, d: str) -> DataFrame:
    ranked = shuffled_rank(scored(spark, d).select("seq_id"), "slices", ["seq_id"])
    return ranked.select("seq_id", F.floor((F.col("rn") - 1) / 500).alias("slice"))


@query("split_inverted_kfold", f"""WITH {SCORED_SQL}, a AS (SELECT seq_id, y FROM r WHERE y = 0 QUALIFY {rank_sql('42n')} <= 2500),
p AS (SELECT seq_id, y, {ntile_sql(5, 42)} AS part FROM a), b AS (SELECT seq_id, y FROM r WHERE y = 1 QUALIFY {rank_sql('42a')} <= 100)
SELECT seq_id, y, CAST(f AS INT) AS fold, CASE WHEN part = f THEN 'fit' ELSE 'test' END AS role FROM p, range(1, 6) AS q(f) UNION ALL SELECT seq_id, y, CAST(f AS INT), 'test' FROM b, range(1, 6) AS q(f)""")
def split_inverted_kfold(spark: SparkSession, d: str) -> DataFrame:
    return splits.inverted_kfold(scored(spark, d).select("seq_id", "y"), 5, 2500, 100, 42, ["seq_id"])


@query("split_stratified_10fold", f"""WITH {SCORED_SQL}, p AS MATERIALIZED (SELECT seq_id, y, {key_sql('42v', 'seq_id')} AS k, {ntile_sql(10, 42)} AS part FROM r),
e2 AS MATERIALIZED (SELECT seq_id, y, k, part, CAST(f AS INT) AS fold FROM p, range(1, 11) AS q(f)),
o AS (SELECT *, row_number() OVER (PARTITION BY fold, y ORDER BY k, seq_id) AS rn FROM e2 WHERE part <> fold),
c AS (SELECT fold, count(*) FILTER (y = 0) AS n FROM e2 WHERE part <> fold GROUP BY fold)
SELECT seq_id, y, fold, CASE WHEN y = 0 THEN CASE WHEN rn <= ceil(n / 10) THEN 'val' ELSE 'train' END WHEN rn <= 100 THEN 'val' ELSE 'unused' END AS role FROM o JOIN c USING (fold)
UNION ALL SELECT seq_id, y, fold, 'test' FROM e2 WHERE part = fold""")
def split_stratified_10fold(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified(scored(spark, d).select("seq_id", "y"), 10, 42, ["seq_id"], most_val=100)


@query("split_all_anomaly", f"""WITH {SCORED_SQL}, p AS (SELECT seq_id, y, {ntile_sql(5, 3)} AS part FROM r WHERE y = 0)
SELECT seq_id, y, CAST(f AS INT) AS fold, CASE WHEN part = f THEN 'test' ELSE 'fit' END AS role FROM p, range(1, 6) AS q(f) UNION ALL SELECT seq_id, y, CAST(f AS INT), 'test' FROM r, range(1, 6) AS q(f) WHERE y = 1""")
def split_all_anomaly(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("seq_id", "y")
    each = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold")
    normal = splits.kfold(rows.where("y = 0"), 5, 3, ["seq_id"]).withColumnRenamed("fold", "part").select("seq_id", "y", "part", each)
    normal = normal.select("seq_id", "y", "fold", F.when(F.col("part") == F.col("fold"), "test").otherwise("fit").alias("role"))
    return normal.unionByName(rows.where("y = 1").select("seq_id", "y", each).withColumn("role", F.lit("test")))


@query("split_natural_scale", f"WITH {SCORED_SQL}, p AS (SELECT seq_id, y, {rank_sql(42, by='y')} AS rn FROM r) SELECT seq_id, y, CASE WHEN y = 0 AND rn <= 1000 THEN 'fit' ELSE 'test' END AS role FROM p")
def split_natural_scale(spark: SparkSession, d: str) -> DataFrame:
    ranked = shuffled_rank(scored(spark, d).select("seq_id", "y"), 42, ["seq_id"], ["y"])
    return ranked.select("seq_id", "y", F.when((F.col("y") == 0) & (F.col("rn") <= 1000), "fit").otherwise("test").alias("role"))


@query("split_random_iter", f"WITH {SCORED_SQL} SELECT seq_id, CAST(i AS INT) AS iteration, CASE WHEN row_number() OVER (PARTITION BY i ORDER BY md5('draw:' || seq_id || ':' || i), seq_id, i) <= 500 THEN 'fit' ELSE 'test' END AS role FROM r, range(4) AS q(i)")
def split_random_iter(spark: SparkSession, d: str) -> DataFrame:
    draws = scored(spark, d).select("seq_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("iteration"))
    ranked = shuffled_rank(draws, "draw", ["seq_id", "iteration"], ["iteration"])
    return ranked.select("seq_id", "iteration", F.when(F.col("rn") <= 500, "fit").otherwise("test").alias("role"))


@query("split_chrono", f"""WITH {EVENTS_SQL}, w AS (SELECT node, CAST(floor(ts_s / {SIX_HOURS}) AS BIGINT) AS window_id, max(y) AS y FROM e WHERE node IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY window_id, node) AS rn, count(*) OVER () AS c FROM w WHERE y = 0),
m AS (SELECT node, window_id, y, CASE WHEN rn <= floor(0.7e0 * c) THEN 'train' WHEN rn <= floor(0.8e0 * c) THEN 'val' ELSE 'test' END AS role FROM n),
a AS (SELECT *, window_id > (SELECT max(window_id) FROM m WHERE role = 'val') AS late FROM w WHERE y = 1),
b AS (SELECT *, row_number() OVER (ORDER BY md5('chrono:' || node || ':' || window_id), node, window_id) AS rn FROM a WHERE NOT late)
SELECT node, window_id, y, role FROM m UNION ALL SELECT node, window_id, y, CASE WHEN rn <= 50 THEN 'val' ELSE 'unused' END FROM b UNION ALL SELECT node, window_id, y, 'test' FROM a WHERE late""")
def split_chrono(spark: SparkSession, d: str) -> DataFrame:
    windows = sequences.node_windows(log_events(spark, d), SIX_HOURS).drop("n_events")
    found = splits.chronological(windows.select("window_id", "node", "y"), ["node", "window_id"], "window_id", most_val=50)
    return found.select("node", "window_id", "y", "role")


# --- thresholds ----------------------------------------------------------------------------------------------


def theta_row(spark: SparkSession, rows: DataFrame, theta: float, digits: int = 6) -> DataFrame:
    return rows.agg(F.round(F.max(F.lit(theta)), digits).alias("theta"), F.count_if(F.col("err") > theta).alias("flagged"))


@query("thr_percentile", f"WITH {SCORED_SQL}, t AS (SELECT quantile_cont(err, 0.95) AS theta FROM r WHERE role = 'test') SELECT round(theta, 6) AS theta, (SELECT count(*) FROM r WHERE role = 'test' AND err > theta) AS flagged FROM t")
def thr_percentile(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).where("role = 'test'")
    return theta_row(spark, rows, thresholds.percentile(rows, 0.95))


@query("thr_percentile_fit", f"WITH {SCORED_SQL}, t AS (SELECT quantile_cont(err, 0.95) AS theta FROM r WHERE role = 'fit') SELECT round(theta, 6) AS theta, (SELECT count(*) FROM r WHERE role = 'test' AND err > theta) AS flagged FROM t")
def thr_percentile_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return theta_row(spark, rows.where("role = 'test'"), thresholds.percentile(rows.where("role = 'fit'"), 0.95))


@query("thr_mean_sigma", f"WITH {SCORED_SQL}, t AS (SELECT avg(err) + 3 * stddev_pop(err) AS theta FROM r) SELECT round(theta, 6) AS theta, (SELECT count(*) FROM r WHERE err > theta) AS flagged FROM t")
def thr_mean_sigma(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return theta_row(spark, rows, thresholds.mean_sigma(rows))


def pot_sql(rows: str, fallback: float) -> str:
    return f"""u AS (SELECT quantile_cont(err, 0.9) AS u, quantile_cont(err, {fallback}) AS back, count(*) AS n, min(err) AS low, max(err) AS high FROM {rows}),
z AS (SELECT any_value(u) AS u, any_value(back) AS back, any_value(n) AS n, any_value(low) AS low, any_value(high) AS high, count(*) FILTER (err > u) AS o,
      avg(err - u) FILTER (err > u) AS m, var_pop(err - u) FILTER (err > u) AS v FROM {rows}, u),
g AS (SELECT *, -0.5e0 * (1 - m * m / v) AS xi, 0.5e0 * m * (m * m / v + 1) AS sigma FROM z),
t AS (SELECT *, CASE WHEN o < 10 OR v = 0 THEN back WHEN xi = 0 THEN u - sigma * ln(1e-3 / (o / n::DOUBLE))
      ELSE u + sigma / xi * (power(1e-3 / (o / n::DOUBLE), -xi) - 1) END AS theta FROM g)"""


@query("thr_pot_mom", f"WITH {SCORED_SQL}, {pot_sql('r', 0.995)} SELECT round(theta, 4) AS theta, (SELECT count(*) FROM r WHERE err > theta) AS flagged FROM t")
def thr_pot_mom(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return theta_row(spark, rows, thresholds.pot(rows), 4)


@query("thr_pot_hdfs", f"WITH {SCORED_SQL}, f AS (SELECT * FROM r WHERE role = 'fit' AND y = 0), {pot_sql('f', 0.95)} SELECT round(theta, 4) AS theta, (SELECT count(*) FROM r WHERE role = 'test' AND err > theta) AS flagged FROM t")
def thr_pot_hdfs(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    theta = thresholds.pot(rows.where("role = 'fit' AND y = 0"), thresholds.Tail(fallback=0.95))
    return theta_row(spark, rows.where("role = 'test'"), theta, 4)


@query("thr_mode_a", f"""WITH {SCORED_SQL}, f AS (SELECT * FROM r WHERE role = 'val' AND y = 0), {pot_sql('f', 0.995)},
c AS (SELECT back, theta, theta IS NULL OR isnan(theta) OR isinf(theta) OR theta <= low OR theta > 5 * high AS fallback FROM t)
SELECT round(CASE WHEN fallback THEN back ELSE theta END, 4) AS theta, fallback, (SELECT count(*) FROM r WHERE role = 'test' AND err > CASE WHEN fallback THEN back ELSE theta END) AS flagged FROM c""")
def thr_mode_a(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    theta, fallback = thresholds.mode_a(rows.where("role = 'val' AND y = 0"))
    return theta_row(spark, rows.where("role = 'test'"), theta, 4).withColumn("fallback", F.lit(fallback))


@query("thr_mode_b", f"""WITH {SCORED_SQL}, v AS (SELECT * FROM r WHERE role = 'val'), q AS (SELECT i, 0.8e0 + (0.999e0 - 0.8e0) * i / 199 AS q FROM range(200) AS z(i)),
a AS (SELECT list(err ORDER BY err) AS l, count(*) AS n, sum(y) AS pos FROM v),
h AS (SELECT i, n, pos, l, (n - 1) * q AS h FROM q, a),
c AS (SELECT i, pos, l[CAST(floor(h) AS INT) + 1] + (l[least(CAST(floor(h) AS INT) + 2, n)] - l[CAST(floor(h) AS INT) + 1]) * (h - floor(h)) AS theta FROM h),
f AS (SELECT i, any_value(theta) AS theta, any_value(pos) AS pos, count(*) FILTER (err > theta AND y = 1) AS tp, count(*) FILTER (err > theta AND y = 0) AS fp FROM c, v GROUP BY i)
SELECT round(theta, 6) AS theta, round(CASE WHEN tp = 0 THEN 0 ELSE 2e0 * tp / (tp + fp + pos) END, 6) AS f1 FROM f ORDER BY round(2e0 * tp / (tp + fp + pos), 12) DESC, i LIMIT 1""")
def thr_mode_b(spark: SparkSession, d: str) -> DataFrame:
    theta, f1 = thresholds.mode_b(scored(spark, d).where("role = 'val'"))
    return one_row(spark, theta=theta, f1=f1).select(r6("theta").alias("theta"), r6("f1").alias("f1"))


@query("thr_pot_mle")
def thr_pot_mle(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return theta_row(spark, rows, thresholds.pot_mle(rows), 4)


# --- metrics -------------------------------------------------------------------------------------------------

FLAG_SQL = f"{SCORED_SQL}, g AS (SELECT *, CASE WHEN err > 150 THEN 1 ELSE 0 END AS flag FROM r)"
CELL_SQL = "count(*) FILTER (flag = 1 AND y = 1) AS tp, count(*) FILTER (flag = 1 AND y = 0) AS fp, count(*) FILTER (flag = 0 AND y = 1) AS fn, count(*) FILTER (flag = 0 AND y = 0) AS tn"
PRF_SQL = "round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"
PRF = ("precision", "recall", "f1")


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("flag", (F.col("err") > 150).cast("int"))


def prf(cells_: DataFrame) -> DataFrame:
    return metrics.precision_recall(cells_).withColumns({c: r6(c) for c in PRF})


@query("eval_confusion", f"WITH {FLAG_SQL} SELECT role, {CELL_SQL} FROM g GROUP BY role")
def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(flagged(spark, d), ["role"])


@query("eval_prf", f"WITH {FLAG_SQL}, c AS (SELECT fold, {CELL_SQL} FROM g GROUP BY fold) SELECT *, {PRF_SQL} FROM c")
def eval_prf(spark: SparkSession, d: str) -> DataFrame:
    return prf(metrics.confusion(flagged(spark, d), ["fold"]))


@query("eval_flag_rate", f"WITH {FLAG_SQL} SELECT fold, round(100 * avg(flag), 6) AS flagged_pct, round(100 * avg(y), 6) AS anomalous_pct FROM g GROUP BY fold")
def eval_flag_rate(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).groupBy("fold").agg(r6(100 * F.avg("flag")).alias("flagged_pct"), r6(100 * F.avg("y")).alias("anomalous_pct"))


BALANCED_SQL = f"b AS (SELECT * FROM g WHERE y = 1 UNION ALL (SELECT * FROM g WHERE y = 0 QUALIFY {rank_sql(43)} <= (SELECT count(*) FROM g WHERE y = 1)))"


@query("eval_balanced", f"WITH {FLAG_SQL}, {BALANCED_SQL}, c AS (SELECT {CELL_SQL} FROM b) SELECT *, {PRF_SQL} FROM c")
def eval_balanced(spark: SparkSession, d: str) -> DataFrame:
    return prf(metrics.confusion(splits.balanced(flagged(spark, d), 43, ["seq_id"])))


@query("eval_average_precision", f"""WITH {SCORED_SQL}, s AS (SELECT err, sum(y) AS p, count(*) AS n FROM r GROUP BY err),
c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM s WINDOW w AS (ORDER BY err DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(p * (cp / cn::DOUBLE)) / sum(p), 6) AS average_precision FROM c""")
def eval_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(scored(spark, d)).select(r6("average_precision").alias("average_precision"))


@query("eval_roc_auc", f"""WITH {SCORED_SQL}, k AS (SELECT y, rank() OVER (ORDER BY err) + (count(*) OVER (PARTITION BY err) - 1) / 2e0 AS midrank FROM r),
c AS (SELECT sum(midrank) FILTER (y = 1) AS s, count(*) FILTER (y = 1)::DOUBLE AS p, count(*) FILTER (y = 0)::DOUBLE AS n FROM k) SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM c""")
def eval_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, d)).select(r6("roc_auc").alias("roc_auc"))


FOLD_SQL = f"{FLAG_SQL}, c AS (SELECT fold, role, {CELL_SQL} FROM g GROUP BY ALL), f AS (SELECT fold, role, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, tp, fp, fn, tn FROM c)"


def fold_results(spark: SparkSession, d: str) -> DataFrame:
    return metrics.precision_recall(metrics.confusion(flagged(spark, d), ["fold", "role"]))


@query("eval_fold_summary", f"WITH {FOLD_SQL} SELECT role, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_std_sample, round(stddev_pop(f1), 6) AS f1_std_pop FROM f GROUP BY role")
def eval_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    return fold_results(spark, d).groupBy("role").agg(r6(F.avg("f1")).alias("f1_mean"), r6(F.stddev_samp("f1")).alias("f1_std_sample"), r6(F.stddev_pop("f1")).alias("f1_std_pop"))


@query("eval_group_mean", f"WITH {FOLD_SQL} SELECT role, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM f GROUP BY role")
def eval_group_mean(spark: SparkSession, d: str) -> DataFrame:
    return fold_results(spark, d).groupBy("role").agg(*[r6(F.avg(c)).alias(c) for c in PRF])


@query("topk_best_variant", f"WITH {FOLD_SQL} SELECT role, round(avg(f1), 6) AS f1 FROM f GROUP BY role ORDER BY f1 DESC, role LIMIT 1")
def topk_best_variant(spark: SparkSession, d: str) -> DataFrame:
    return fold_results(spark, d).groupBy("role").agg(r6(F.avg("f1")).alias("f1")).orderBy(F.desc("f1"), "role").limit(1)


@query("eval_seed_summary", f"WITH {FOLD_SQL} SELECT count(*) FILTER (f1 >= 0.5) AS successes, round(avg(f1), 6) AS mean, round(min(f1), 6) AS low, round(max(f1), 6) AS high, arg_max(fold, round(f1, 9) * 1000 - fold) AS best_seed FROM f WHERE role = 'fit'")
def eval_seed_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = fold_results(spark, d).where("role = 'fit'")
    best = F.max_by("fold", F.round("f1", 9) * 1000 - F.col("fold"))
    return rows.agg(F.count_if(F.col("f1") >= 0.5).alias("successes"), r6(F.avg("f1")).alias("mean"), r6(F.min("f1")).alias("low"), r6(F.max("f1")).alias("high"), best.alias("best_seed"))


@query("eval_mean_confusion", f"WITH {FOLD_SQL} SELECT role, round(avg(tp), 6) AS tp, round(avg(fp), 6) AS fp, round(avg(fn), 6) AS fn, round(avg(tn), 6) AS tn FROM f GROUP BY role")
def eval_mean_confusion(spark: SparkSession, d: str) -> DataFrame:
    return fold_results(spark, d).groupBy("role").agg(*[r6(F.avg(c)).alias(c) for c in metrics.CELLS])


@query("eval_compare_modes", f"""WITH {FLAG_SQL}, {BALANCED_SQL}, c AS (SELECT 'natural' AS prevalence, {CELL_SQL} FROM g UNION ALL SELECT 'balanced', {CELL_SQL} FROM b),
p AS (SELECT prevalence, {PRF_SQL} FROM c) SELECT prevalence, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM p""")
def eval_compare_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = flagged(spark, d)
    both = metrics.confusion(rows).withColumn("prevalence", F.lit("natural")).unionByName(metrics.confusion(splits.balanced(rows, 43, ["seq_id"])).withColumn("prevalence", F.lit("balanced")))
    return prf(both).unpivot("prevalence", list(PRF), "metric", "value")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return session_labels(spark, d)
