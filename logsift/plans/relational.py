"""Sources, filters, joins, aggregates, windows, sets and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions import parsing
from logsift.operators import features, sequences, splits, thresholds
from logsift.operators.ranks import quantiles, quantiles_by, running_sums, shuffle_key
from logsift.plans.registry import one_row, query, r6
from logsift.session import shared_dir
from logsift.sources import logs
from logsift.sources.templates import Tree
from logsift.views import EVENTS_SQL, FIVE_MINUTES, LINE_ORDER, SCORED_SQL, SESSIONS_SQL, SIX_HOURS, WEEK, log_events, log_sessions, scored, session_labels, session_lines, table, vec64

LINES_SQL = f"WITH {EVENTS_SQL}\n"


# --- sources and sinks ---------------------------------------------------------------------------------------


@query("src_parse_header", LINES_SQL + "SELECT CASE WHEN y = 1 THEN 'A' ELSE '-' END AS label, CAST(ts_s AS VARCHAR) AS ts, CAST(node AS VARCHAR) AS node, event_id || ' value ' || k AS content FROM e")
def src_parse_header(spark: SparkSession, d: str) -> DataFrame:
    e = log_events(spark, d)
    label = F.when(F.col("y") == 1, "A").otherwise("-")
    content = F.concat_ws(" ", "event_id", F.lit("value"), F.col("k").cast("string"))
    lines = e.select(F.concat_ws(" ", label, F.col("ts_s").cast("string"), F.col("node").cast("string"), content).alias("value"))
    return logs.parse_lines(lines, "<label> <ts> <node> <content>")


@query("src_template_mask", """
SELECT template, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(props || ' ' || event_type || ' ' || user_id,
  '0x[0-9a-fA-F]+', '<hex>', 'g'), '[0-9]{1,3}(\\.[0-9]{1,3}){3}(:[0-9]+)?', '<ip>', 'g'), '[0-9]+(\\.[0-9]+)?', '<num>', 'g') AS template FROM events) GROUP BY template""")  # fmt: skip
def src_template_mask(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    text = F.concat_ws(" ", "props", "event_type", F.col("user_id").cast("string"))
    return e.select(logs.masked(text).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


def content() -> Column:
    """A message of a log event. Masked messages of two event types differ in their first token, so that each is a leaf of one text."""
    return F.concat_ws(" ", "event_id", F.lit("on"), F.concat(F.lit("node"), F.col("node") % 3), F.lit("took"), F.col("k").cast("string"), F.lit("ms"))


MINED_SQL = f"""{LINES_SQL}, m AS (SELECT line_id, regexp_replace(event_id || ' on node' || node % 3 || ' took ' || k || ' ms', '[0-9]+(\\.[0-9]+)?', '<num>', 'g') AS template FROM e)
SELECT substr(md5(template), 1, 8) AS template_id, template, min(line_id) AS cluster, count(*) AS n FROM m GROUP BY template"""


@query("src_drain", MINED_SQL)
def src_drain(spark: SparkSession, d: str) -> DataFrame:
    found = logs.mine_templates(log_events(spark, d).select("line_id", content().alias("content")))
    return found.groupBy("template_id", "template", "cluster").agg(F.count("*").alias("n"))


#: Texts of five tokens: a leaf for each event type, in which the node's group and the value's vary, and merge into one template.
TREE_SQL = f"""{LINES_SQL}, t AS (SELECT line_id, split_part(event_id, '_', 1) AS kind, 'shard-' || chr(CAST(97 + node % 26 AS INTEGER)) AS shard, 'grade-' || chr(CAST(97 + k % 4 AS INTEGER)) AS grade FROM e)
SELECT kind || ' from ' || CASE WHEN count(DISTINCT shard) > 1 THEN '<*>' ELSE min(shard) END || ' had ' || CASE WHEN count(DISTINCT grade) > 1 THEN '<*>' ELSE min(grade) END AS template,
       min(line_id) AS cluster, count(*) AS n FROM t GROUP BY kind"""


@query("src_drain_tree", TREE_SQL)
def src_drain_tree(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of many distinct texts, dealt to buckets of about eight and merged again."""
    sign = lambda name, k, n: F.concat(F.lit(f"{name}-"), F.char(97 + k % n))
    text = F.concat_ws(" ", F.substring_index("event_id", "_", 1), F.lit("from"), sign("shard", F.col("node"), 26), F.lit("had"), sign("grade", F.col("k"), 4))
    found = logs.mine_templates(log_events(spark, d).select("line_id", text.alias("content")), Tree(split=8))
    return found.groupBy("template", "cluster").agg(F.count("*").alias("n"))


@query("src_csv_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def src_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query("sink_parquet_roundtrip", "SELECT doc_id, lang, source, n_chars FROM documents")
def sink_parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    path = f"{shared_dir(spark)}/parquet-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@query("src_pruned_scan", "SELECT user_id AS node, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY user_id")
def src_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "ts").groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


@query("fn_parse_token_list", LINES_SQL + "SELECT line_id, event_id AS first_token, CAST(2 AS INT) AS n FROM e")
def fn_parse_token_list(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("["), "event_id", F.lit(", "), F.col("node").cast("string"), F.lit("]"))
    tokens = parsing.token_list(text)
    return log_events(spark, d).select("line_id", tokens[0].alias("first_token"), F.size(tokens).alias("n"))


@query("fn_parse_event_list", LINES_SQL + "SELECT line_id, CASE WHEN k % 5 = 0 THEN '' ELSE event_id || '|' || node END AS tokens FROM e")
def fn_parse_event_list(spark: SparkSession, d: str) -> DataFrame:
    begin = F.when(F.col("k") % 5 == 0, "(").otherwise("[")
    text = F.concat(begin, F.lit("'"), "event_id", F.lit("', , \""), F.col("node").cast("string"), F.lit('"]'))
    return log_events(spark, d).select("line_id", F.array_join(parsing.event_list(text), "|").alias("tokens"))


@query("fn_parse_float_list", LINES_SQL + "SELECT line_id, CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN k % 4 = 0 THEN 0e0 ELSE k + 0.5e0 END AS total FROM e")
def fn_parse_float_list(spark: SparkSession, d: str) -> DataFrame:
    second = F.when(F.col("k") % 4 == 0, "x").otherwise("0.5")
    values = parsing.float_list(F.concat(F.lit("["), F.col("k").cast("string"), F.lit(", "), second, F.lit("]")))
    return log_events(spark, d).select("line_id", F.size(values).alias("n"), F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"))


@query("feat_vocab_natural_order", "SELECT p_brand AS event_id, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT), p_brand) - 1 AS col_idx FROM (SELECT DISTINCT p_brand FROM part)")
def feat_vocab_natural_order(spark: SparkSession, d: str) -> DataFrame:
    return features.natural_vocabulary(table(spark, d, "part"), "p_brand")


# --- filters and projections ---------------------------------------------------------------------------------


@query("flt_normals", LINES_SQL + "SELECT line_id FROM e WHERE y = 0")
def flt_normals(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).where("y = 0").select("line_id")


@query("flt_threshold", f"WITH {SCORED_SQL} SELECT seq_id, CASE WHEN err > 100 THEN 1 ELSE 0 END AS flag FROM r")
def flt_threshold(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("seq_id", (F.col("err") > 100).cast("int").alias("flag"))


@query("flt_isin", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def flt_isin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type")


@query("flt_mask_count", f"WITH {SCORED_SQL} SELECT count(*) FILTER (err > 150 AND y = 1) AS n FROM r")
def flt_mask_count(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(F.count_if((F.col("err") > 150) & (F.col("y") == 1)).alias("n"))


@query("diag_hidden_anomalies", f"WITH {SCORED_SQL} SELECT count(*) AS n, max(err) AS highest FROM r WHERE y = 1 AND err <= (SELECT max(err) FROM r WHERE y = 0)")
def diag_hidden_anomalies(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    most = rows.where("y = 0").agg(F.max("err")).first()[0]
    return rows.where((F.col("y") == 1) & (F.col("err") <= most)).agg(F.count("*").alias("n"), F.max("err").alias("highest"))


@query("prj_label_map", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS y FROM orders")
def prj_label_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("y"))


@query("prj_dict_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Normal' WHEN 'O' THEN 'Anomaly' END AS label FROM orders")
def prj_dict_map(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(status == "F", "Normal").when(status == "O", "Anomaly").alias("label"))


@query("dq_label_agreement", """
WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Normal' WHEN 'O' THEN 'Anomaly' END AS a,
                  CASE WHEN o_totalprice > 200000 THEN 'Anomaly' ELSE 'Normal' END AS b FROM orders)
SELECT count(*) AS n, count(*) FILTER (a IS DISTINCT FROM b) AS mismatches, min(o_orderkey) FILTER (a IS DISTINCT FROM b) AS first_example FROM c""")  # fmt: skip
def dq_label_agreement(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(status == "F", "Normal").when(status == "O", "Anomaly").alias("a"), F.when(F.col("o_totalprice") > 200000, "Anomaly").otherwise("Normal").alias("b")
    )
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    return rows.agg(F.count("*").alias("n"), F.count_if(differ).alias("mismatches"), F.min(F.when(differ, F.col("o_orderkey"))).alias("first_example"))


@query("split_gather", f"WITH {SCORED_SQL} SELECT r.seq_id, e.event_id, role FROM r JOIN e ON r.seq_id = e.line_id WHERE role = 'val'")
def split_gather(spark: SparkSession, d: str) -> DataFrame:
    roles = scored(spark, d).where("role = 'val'").select("seq_id", "role")
    return log_events(spark, d).join(roles, F.col("line_id") == F.col("seq_id")).select("seq_id", "event_id", "role")


# --- joins ---------------------------------------------------------------------------------------------------


@query("join_inner_labels", "SELECT doc_id, lang AS lang_matrix, quality AS quality_truth, toxic AS toxic_truth FROM documents JOIN labels USING (doc_id)")
def join_inner_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("quality_truth"), F.col("toxic").alias("toxic_truth"))
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("lang_matrix")).join(labels, "doc_id")


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    customers = table(spark, d, "customer").select("c_custkey")
    return customers.join(big, customers.c_custkey == big.o_custkey, "left_semi")


@query("join_left_fill", "SELECT c_custkey, coalesce(count(o_orderkey), 0) AS n_orders, coalesce(max(o_totalprice), 0) AS largest FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left_fill(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.max("o_totalprice").alias("largest"))
    joined = table(spark, d, "customer").select("c_custkey").join(by, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("largest", F.lit(0.0)).alias("largest"))


VOCAB_SQL = "v AS (SELECT event_id, count(*) AS n FROM e WHERE y = 0 AND k % 2 = 0 GROUP BY event_id)"


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Templates of normal lines with an even k."""
    return log_events(spark, d).where("y = 0 AND k % 2 = 0").groupBy("event_id").agg(F.count("*").alias("n"))


@query("join_vocab_inner", LINES_SQL[:-1] + f", {VOCAB_SQL} SELECT line_id, event_id, n FROM e JOIN v USING (event_id)")
def join_vocab_inner(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).select("line_id", "event_id").join(vocabulary(spark, d), "event_id")


@query("join_idf_default", LINES_SQL[:-1] + f", {VOCAB_SQL} SELECT line_id, coalesce(n / 10e0, 1e0) AS idf FROM e LEFT JOIN v USING (event_id)")
def join_idf_default(spark: SparkSession, d: str) -> DataFrame:
    joined = log_events(spark, d).select("line_id", "event_id").join(vocabulary(spark, d), "event_id", "left")
    return joined.select("line_id", F.coalesce(F.col("n") / 10.0, F.lit(1.0)).alias("idf"))


@query("join_oov_anti", LINES_SQL[:-1] + f", {VOCAB_SQL} SELECT event_id, count(*) AS n FROM e ANTI JOIN v USING (event_id) GROUP BY event_id")
def join_oov_anti(spark: SparkSession, d: str) -> DataFrame:
    return log_events(spark, d).join(vocabulary(spark, d), "event_id", "left_anti").groupBy("event_id").agg(F.count("*").alias("n"))


# --- aggregates ----------------------------------------------------------------------------------------------


@query("agg_window_event_counts", LINES_SQL + f"SELECT CAST(floor(ts_s / {FIVE_MINUTES}) AS BIGINT) AS window_id, event_id, count(*) AS n FROM e GROUP BY ALL")
def agg_window_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return sequences.tumbling(log_events(spark, d), FIVE_MINUTES).groupBy("window_id", "event_id").agg(F.count("*").alias("n"))


TYPES = ("click", "error", "purchase", "signup", "view")


@query("agg_pivot_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in TYPES) + " FROM events GROUP BY user_id")
def agg_pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type", list(TYPES)).count().na.fill(0)
    return wide.withColumnsRenamed({t: f"n_{t}" for t in TYPES})


@query("agg_any_anomaly", LINES_SQL + f"SELECT node, CAST(floor(ts_s / {WEEK}) AS BIGINT) AS window_id, max(y) AS y FROM e GROUP BY ALL")
def agg_any_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return sequences.tumbling(log_events(spark, d), WEEK).groupBy("node", "window_id").agg(F.max("y").alias("y"))


@query("agg_collect_sequence", LINES_SQL + f"SELECT node, CAST(floor(ts_s / {WEEK}) AS BIGINT) AS window_id, string_agg(event_id, ' ' ORDER BY ts_s, line_id) AS events FROM e GROUP BY ALL")
def agg_collect_sequence(spark: SparkSession, d: str) -> DataFrame:
    found = sequences.collect_sequences(sequences.tumbling(log_events(spark, d), WEEK), ["node", "window_id"], ["ts_s", "line_id"])
    return found.withColumn("events", F.array_join("events", " "))


@query("agg_doc_freq", LINES_SQL + "SELECT event_id, count(DISTINCT node) AS df FROM e GROUP BY event_id")
def agg_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return features.doc_frequency(features.counts(log_events(spark, d), "node")).withColumnRenamed("term", "event_id")


@query("agg_oov_rate", LINES_SQL[:-1] + f", {VOCAB_SQL} SELECT count(*) AS total, count(*) FILTER (v.event_id IS NULL) AS oov, round(count(*) FILTER (v.event_id IS NULL) / count(*)::DOUBLE, 6) AS rate FROM e LEFT JOIN v USING (event_id)")
def agg_oov_rate(spark: SparkSession, d: str) -> DataFrame:
    joined = log_events(spark, d).join(vocabulary(spark, d).withColumnRenamed("n", "known"), "event_id", "left")
    oov = F.count_if(F.col("known").isNull())
    return joined.agg(F.count("*").alias("total"), oov.alias("oov"), F.coalesce(r6(F.try_divide(oov.cast("double"), F.count("*").cast("double"))), F.lit(0.0)).alias("rate"))


POS_SQL = "x AS (SELECT vec_id AS seq_id, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings)"


@query("agg_column_mean", f"WITH {POS_SQL} SELECT CAST(k AS INT) AS k, round(avg(v), 6) + 0 AS mean FROM x GROUP BY k")
def agg_column_mean(spark: SparkSession, d: str) -> DataFrame:
    return vec64(spark, d).select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(r6(F.avg("v")).alias("mean"))


CELLS_SQL = f"{SESSIONS_SQL}, c AS (SELECT seq_id, event_id AS term, count(*) AS value FROM s GROUP BY ALL), n AS (SELECT count(DISTINCT seq_id) AS n FROM s)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return features.counts(log_sessions(spark, d))


@query("feat_column_scale", f"WITH {CELLS_SQL} SELECT term, round(sqrt(sum(value * value) / any_value(n) - power(sum(value) / any_value(n), 2)), 6) AS scale FROM c, n GROUP BY term")
def feat_column_scale(spark: SparkSession, d: str) -> DataFrame:
    held = cells(spark, d)
    n = held.select("seq_id").distinct().count()
    return features.column_scaled(held, n).groupBy("term").agg(r6(F.max("scale")).alias("scale"))


@query("feat_max_scale", f"WITH {CELLS_SQL}, m AS (SELECT term, max(value) AS most FROM c GROUP BY term) SELECT seq_id, term, round(value / most::DOUBLE, 6) AS value FROM c JOIN m USING (term)")
def feat_max_scale(spark: SparkSession, d: str) -> DataFrame:
    held = cells(spark, d)
    return features.column_scaled(held, 1, "max").select("seq_id", "term", r6("value").alias("value"))


@query("agg_quantile", f"WITH {SCORED_SQL} SELECT unnest([0.5, 0.9, 0.95, 0.995]) AS q, round(unnest(quantile_cont(err, [0.5, 0.9, 0.95, 0.995])), 6) AS value FROM r")
def agg_quantile(spark: SparkSession, d: str) -> DataFrame:
    qs = [0.5, 0.9, 0.95, 0.995]
    return spark.createDataFrame(list(zip(qs, quantiles(scored(spark, d), "err", qs), strict=True)), "q double, value double").select("q", r6("value").alias("value"))


@query("agg_moments", f"WITH {SCORED_SQL} SELECT role, round(avg(err), 6) AS mean, round(var_pop(err), 4) AS var, round(stddev_pop(err), 6) AS std FROM r GROUP BY role")
def agg_moments(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("role").agg(r6(F.avg("err")).alias("mean"), F.round(F.var_pop("err"), 4).alias("var"), r6(F.stddev_pop("err")).alias("std"))


@query("agg_argmax", f"WITH {SCORED_SQL}, m AS (SELECT role, avg(err) AS a FROM r GROUP BY role) SELECT role, round(a, 6) AS mean FROM m ORDER BY a DESC, role LIMIT 1")
def agg_argmax(spark: SparkSession, d: str) -> DataFrame:
    means = scored(spark, d).groupBy("role").agg(F.avg("err").alias("a"))
    return means.orderBy(F.desc("a"), "role").limit(1).select("role", r6("a").alias("mean"))


@query("agg_distinct_scores", f"WITH {SCORED_SQL} SELECT count(DISTINCT err) AS n FROM r")
def agg_distinct_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(F.countDistinct("err").alias("n"))


@query("diag_score_distribution", f"WITH {SCORED_SQL} SELECT y, round(min(err), 6) AS low, round(quantile_cont(err, 0.05), 6) AS p5, round(quantile_cont(err, 0.5), 6) AS median, round(quantile_cont(err, 0.95), 6) AS p95, round(max(err), 6) AS high FROM r GROUP BY y")
def diag_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = quantiles_by(scored(spark, d), "err", [0.0, 0.05, 0.5, 0.95, 1.0], ["y"]).pivot(index="y", columns="q", values="value")
    rows = [(int(y), *map(float, v)) for y, v in zip(found.index, found.to_numpy(), strict=True)]  # a row for each label
    names = ("low", "p5", "median", "p95", "high")
    return spark.createDataFrame(rows, f"y int, {', '.join(f'{c} double' for c in names)}").select("y", *[r6(c).alias(c) for c in names])


@query("diag_histogram", f"""WITH {SCORED_SQL}, h AS (SELECT y, CAST(least(floor(err / 400e0 * 79), 78) AS INT) AS bin FROM r WHERE err BETWEEN 0 AND 400)
SELECT y, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY y) * (400e0 / 79)), 8) AS density FROM h GROUP BY y, bin""")
def diag_histogram(spark: SparkSession, d: str) -> DataFrame:
    held = scored(spark, d).where(F.col("err").between(0, 400))
    by = held.groupBy("y", F.least(F.floor(F.col("err") / 400.0 * 79), F.lit(78)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = by.groupBy("y").agg(F.sum("n").alias("total"))
    return by.join(total, "y").select("y", "bin", "n", F.round(F.col("n") / (F.col("total") * (F.lit(400.0) / 79)), 8).alias("density"))


@query("agg_prevalence", f"WITH {SCORED_SQL} SELECT role, round(avg(y), 6) AS prevalence FROM r GROUP BY role")
def agg_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("role").agg(r6(F.avg("y")).alias("prevalence"))


# --- windows and order ---------------------------------------------------------------------------------------


@query("win_tumbling_5m", LINES_SQL + f"SELECT CAST(floor(ts_s / {FIVE_MINUTES}) AS BIGINT) AS window_id, count(*) AS n_events, max(y) AS y FROM e GROUP BY ALL")
def win_tumbling_5m(spark: SparkSession, d: str) -> DataFrame:
    return sequences.tumbling(log_events(spark, d), FIVE_MINUTES).groupBy("window_id").agg(F.count("*").alias("n_events"), F.max("y").alias("y"))


@query("win_node_6h", LINES_SQL + f"SELECT node, CAST(floor(ts_s / {SIX_HOURS}) AS BIGINT) AS window_id, count(*) AS n_events, max(y) AS y FROM e WHERE node IS NOT NULL GROUP BY ALL")
def win_node_6h(spark: SparkSession, d: str) -> DataFrame:
    return sequences.node_windows(log_events(spark, d), SIX_HOURS)


@query("win_session_id", f"WITH {SESSIONS_SQL} SELECT seq_id, count(*) AS n_events, string_agg(event_id, ' ' ORDER BY pos) AS events, max(y) AS y FROM s GROUP BY seq_id")
def win_session_id(spark: SparkSession, d: str) -> DataFrame:
    lines = log_sessions(spark, d)
    got = lines.groupBy("seq_id").agg(F.count("*").alias("n_events"), F.max("y").alias("y"))
    return got.join(sequences.collect_sequences(lines, ["seq_id"], ["pos"]), "seq_id").withColumn("events", F.array_join("events", " "))


@query("win_fixed_count", LINES_SQL[:-1] + ", f AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY ts_s, line_id) - 1) // 10 AS window_no FROM e) SELECT node, window_no, count(*) AS n, max(y) AS y FROM f GROUP BY ALL")
def win_fixed_count(spark: SparkSession, d: str) -> DataFrame:
    held = sequences.fixed_count(log_events(spark, d), 10, ["node"], ["ts_s", "line_id"])
    return held.groupBy("node", "window_no").agg(F.count("*").alias("n"), F.max("y").alias("y"))


BIGRAM_SQL = f"{SESSIONS_SQL}, g AS (SELECT seq_id, event_id AS a, lead(event_id) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM s), b AS (SELECT seq_id, a, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL)"


def session_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return sequences.bigrams(session_lines(spark, d), ["seq_id"], [*LINE_ORDER]).groupBy("seq_id", "a", "b").agg(F.count("*").alias("n"))


@query("win_bigram_counts", f"WITH {BIGRAM_SQL} SELECT seq_id, a, b, n FROM b")
def win_bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return session_bigrams(spark, d)


@query("topk_bigrams", f"WITH {BIGRAM_SQL} SELECT a || '->' || b AS label, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL ORDER BY n DESC, label LIMIT 10")
def topk_bigrams(spark: SparkSession, d: str) -> DataFrame:
    by = session_bigrams(spark, d).groupBy(F.concat_ws("->", "a", "b").alias("label")).agg(F.sum("n").alias("n"))
    return by.orderBy(F.desc("n"), "label").limit(10)


@query("feat_bigram_vocab", f"WITH {BIGRAM_SQL} SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS col_idx FROM (SELECT DISTINCT a, b FROM b)")
def feat_bigram_vocab(spark: SparkSession, d: str) -> DataFrame:
    pairs = session_bigrams(spark, d).select("a", "b").distinct()
    return running_sums(pairs, [F.col("a"), F.col("b")], {"rn": F.lit(1)}).select("a", "b", (F.col("rn") - 1).alias("col_idx"))


@query("set_distinct_bigrams", f"WITH {BIGRAM_SQL} SELECT DISTINCT a, b FROM b")
def set_distinct_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return session_bigrams(spark, d).select("a", "b").distinct()


@query("thr_top_fraction", f"WITH {SCORED_SQL} SELECT seq_id FROM r QUALIFY row_number() OVER (ORDER BY err DESC, seq_id) <= (SELECT ceil(0.05 * count(*)) FROM r)")
def thr_top_fraction(spark: SparkSession, d: str) -> DataFrame:
    return thresholds.top_fraction(scored(spark, d)).where("flag = 1").select("seq_id")


@query("thr_nth_largest", f"WITH {SCORED_SQL}, t AS (SELECT min(err) AS theta FROM (SELECT err FROM r ORDER BY err DESC LIMIT 100)) SELECT round(theta, 6) AS theta, (SELECT count(*) FROM r WHERE err > theta) AS flagged FROM t")
def thr_nth_largest(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    theta = thresholds.nth_largest(rows, 100)
    return rows.agg(r6(F.max(F.lit(theta))).alias("theta"), F.count_if(F.col("err") > theta).alias("flagged"))


# --- sets and samples ----------------------------------------------------------------------------------------


def key_sql(seed: object, expr: str) -> str:
    return f"md5('{seed}:' || {expr})"


@query("set_union_test", f"WITH {SCORED_SQL} SELECT seq_id, y FROM r WHERE role = 'test' AND y = 0 UNION ALL SELECT seq_id, y FROM r WHERE y = 1")
def set_union_test(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("seq_id", "y", "role")
    return rows.where("role = 'test' AND y = 0").drop("role").unionByName(rows.where("y = 1").drop("role"))


def rank_sql(seed: object, expr: str = "seq_id", by: str = "") -> str:
    return f"row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {key_sql(seed, expr)}, {expr})"


@query("smp_exact_n", f"WITH {SCORED_SQL} SELECT seq_id FROM r QUALIFY {rank_sql(42)} <= 500")
def smp_exact_n(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample_exact(scored(spark, d).select("seq_id"), 500, 42, ["seq_id"])


@query("smp_capped", f"WITH {SCORED_SQL} SELECT seq_id FROM r WHERE y = 1 QUALIFY {rank_sql(143)} <= 300")
def smp_capped(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample_exact(scored(spark, d).where("y = 1").select("seq_id"), 300, 143, ["seq_id"])


@query("smp_balanced", f"WITH {SCORED_SQL} SELECT seq_id, y FROM r WHERE y = 1 UNION ALL (SELECT seq_id, y FROM r WHERE y = 0 QUALIFY {rank_sql(42)} <= (SELECT count(*) FROM r WHERE y = 1))")
def smp_balanced(spark: SparkSession, d: str) -> DataFrame:
    return splits.balanced(scored(spark, d).select("seq_id", "y"), 42, ["seq_id"])


@query("set_except_pool", f"WITH {SCORED_SQL} SELECT seq_id FROM r WHERE y = 1 EXCEPT (SELECT seq_id FROM r WHERE y = 1 QUALIFY {rank_sql(7)} <= 200)")
def set_except_pool(spark: SparkSession, d: str) -> DataFrame:
    odd = scored(spark, d).where("y = 1").select("seq_id")
    return odd.join(splits.sample_exact(odd, 200, 7, ["seq_id"]), "seq_id", "left_anti")


@query("split_contaminated", f"""WITH {SCORED_SQL}, f AS (SELECT seq_id, y FROM r WHERE role = 'fit' AND y = 0),
p AS (SELECT seq_id, y FROM r WHERE role = 'fit' AND y = 1 QUALIFY {rank_sql('c')} <= greatest(1, floor((SELECT count(*) FROM f) * 0.05)))
SELECT * FROM f UNION ALL SELECT * FROM p""")
def split_contaminated(spark: SparkSession, d: str) -> DataFrame:
    fit = scored(spark, d).where("role = 'fit'").select("seq_id", "y")
    n = max(1, int(fit.where("y = 0").count() * 0.05))
    return fit.where("y = 0").unionByName(splits.sample_exact(fit.where("y = 1"), n, "c", ["seq_id"]))


@query("model_random_guess", f"WITH {SCORED_SQL} SELECT seq_id, CASE WHEN {key_sql('guess', 'seq_id')} < '1a000000' THEN 1 ELSE 0 END AS flag FROM r")
def model_random_guess(spark: SparkSession, d: str) -> DataFrame:
    """Bernoulli flags of probability 0x1a / 0x100."""
    return scored(spark, d).select("seq_id", (shuffle_key("guess", "seq_id") < "1a000000").cast("int").alias("flag"))


@query("model_all_normal", f"WITH {SCORED_SQL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS flagged, round(avg(y), 6) AS pr_auc, 0.5e0 AS roc_auc FROM r")
def model_all_normal(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("flagged"), r6(F.avg("y")).alias("pr_auc"), F.lit(0.5).alias("roc_auc"))


# --- text lint -----------------------------------------------------------------------------------------------


@query("txt_forbidden_phrases", "SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(license|released|copyright)\\b')) AS n FROM documents WHERE regexp_matches(text, '(?i)\\b(license|released|copyright)\\b')")
def txt_forbidden_phrases(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"(?i)\b(license|released|copyright)\b")).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n")).where("n > 0")


@query("txt_brace_balance", """
SELECT page_id, CAST(length(html) - length(replace(html, '<', '')) AS BIGINT) AS opened, CAST(length(html) - length(replace(html, '>', '')) AS BIGINT) AS closed,
       length(html) - length(replace(html, '<', '')) = length(html) - length(replace(html, '>', '')) AS balanced FROM pages""")  # fmt: skip
def txt_brace_balance(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: (F.length("html") - F.length(F.replace("html", F.lit(c), F.lit("")))).cast("long")
    return table(spark, d, "pages").select("page_id", n("<").alias("opened"), n(">").alias("closed"), (n("<") == n(">")).alias("balanced"))


@query("txt_set_difference", """
WITH t AS (SELECT page_id, list_distinct(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS o, list_distinct(regexp_extract_all(html, '</([a-z0-9]+)', 1)) AS c FROM pages)
SELECT page_id, array_to_string(list_sort(list_filter(o, lambda x : NOT list_contains(c, x))), ',') AS never_closed FROM t""")  # fmt: skip
def txt_set_difference(spark: SparkSession, d: str) -> DataFrame:
    tags = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    missing = F.array_except(tags("<([a-z0-9]+)"), tags("</([a-z0-9]+)"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(missing), ",").alias("never_closed"))


@query("txt_word_count", "SELECT source, CAST(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n_words FROM documents GROUP BY source")
def txt_word_count(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return table(spark, d, "documents").groupBy("source").agg(F.sum(n).cast("long").alias("n_words"))


@query("set_disjointness", f"""WITH {SCORED_SQL} SELECT (SELECT count(*) FROM (SELECT seq_id FROM r WHERE role = 'fit' INTERSECT SELECT seq_id FROM r WHERE role = 'val')) AS fit_val,
(SELECT count(*) FROM (SELECT seq_id FROM r WHERE role = 'fit' INTERSECT SELECT seq_id FROM r WHERE role = 'test')) AS fit_test""")
def set_disjointness(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).select("seq_id", "role")
    part = lambda role: rows.where(F.col("role") == role).select("seq_id")
    return one_row(spark, fit_val=part("fit").intersect(part("val")).count(), fit_test=part("fit").intersect(part("test")).count())


__all__ = ["session_labels"]
