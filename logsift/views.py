"""Log-shaped views of the test tables, and the same views as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.session import PART_ROWS, configured, in_parts

WEEK, SIX_HOURS, FIVE_MINUTES = 604_800, 21_600, 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configured(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured windowed log: line_id, node, ts_s (unix seconds), event_id (30 templates), value, y."""
    return as_log(table(spark, sf_dir, "events"))


def as_log(e: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return e.select(
        F.col("event_id").alias("line_id"), F.col("user_id").alias("node"), F.unix_timestamp("ts").alias("ts_s"),
        F.concat_ws("_", "event_type", (k % 6).cast("string")).alias("event_id"), "value", (F.col("value") > 200).cast("int").alias("y"), k.alias("k"), "ts",
    )


#: The order of a session's lines.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the session log: seq_id, event_id (25 templates), ts_s, y, and what LINE_ORDER names; each session in one part."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = li.count()  # of the files' footers
    part, li = (F.broadcast(part), li) if part.count() <= PART_ROWS else (part, in_parts(li, rows, "l_partkey"))
    y = ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.095)).cast("int")
    joined = li.join(part, li.l_partkey == part.p_partkey)
    lines = joined.select(F.col("l_orderkey").alias("seq_id"), F.col("p_brand").alias("event_id"), F.unix_timestamp("l_shipdate").alias("ts_s"), y.alias("y"), *LINE_ORDER)
    return in_parts(lines, rows, "seq_id")


def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session log: seq_id, pos (from 1), event_id (25 templates), ts_s, y of the line."""
    order = Window.partitionBy("seq_id").orderBy(*LINE_ORDER)
    return session_lines(spark, sf_dir).select("seq_id", F.row_number().over(order).alias("pos"), "event_id", "ts_s", "y")


def session_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_sessions(spark, sf_dir).groupBy("seq_id").agg(F.max("y").alias("y"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with labels and roles: seq_id, err, y, role (fit, val, test), fold (0 to 4)."""
    e = log_events(spark, sf_dir)
    h = F.md5(F.concat(F.lit("role"), F.col("line_id").cast("string")))
    role = F.when(F.substring(h, 1, 1) < "8", "fit").when(F.substring(h, 1, 1) < "c", "val").otherwise("test")
    err = F.col("value") * (F.lit(1.0) + (F.col("k") % 7).cast("double") / F.lit(10.0))
    y = ((F.col("value") > 180) | (F.col("node") % 23 == 0)).cast("int")
    return e.select(F.col("line_id").alias("seq_id"), err.alias("err"), y.alias("y"), role.alias("role"), (F.col("line_id") % 5).alias("fold"))


def vec64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense feature rows: seq_id, x (64 doubles), y."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq_id"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 9).cast("int").alias("y"))


EVENTS_SQL = """e AS (
  SELECT event_id AS line_id, user_id AS node, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
         event_type || '_' || (CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6) AS event_id, value,
         CASE WHEN value > 200 THEN 1 ELSE 0 END AS y, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events)"""
SESSIONS_SQL = """s AS (
  SELECT l_orderkey AS seq_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS pos,
         p_brand AS event_id, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts_s,
         CASE WHEN l_returnflag = 'R' AND l_discount >= 0.095 THEN 1 ELSE 0 END AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SCORED_SQL = (
    EVENTS_SQL
    + """, r AS (
  SELECT line_id AS seq_id, value * (1e0 + CAST(k % 7 AS DOUBLE) / 10e0) AS err,
         CASE WHEN value > 180 OR node % 23 = 0 THEN 1 ELSE 0 END AS y,
         CASE WHEN substr(md5('role' || line_id), 1, 1) < '8' THEN 'fit' WHEN substr(md5('role' || line_id), 1, 1) < 'c' THEN 'val' ELSE 'test' END AS role,
         line_id % 5 AS fold
  FROM e)"""
)
