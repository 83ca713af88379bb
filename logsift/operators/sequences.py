"""Grouping of log lines into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(lines: DataFrame, seconds: int, ts: str = "ts_s", name: str = "window_id") -> DataFrame:
    """lines with the number of the tumbling window that holds their unix second."""
    return lines.withColumn(name, F.floor(F.col(ts) / seconds))


def node_windows(lines: DataFrame, seconds: int) -> DataFrame:
    """One sequence for each node and tumbling window: (node, window_id, n_events, y); lines of a null node are left out."""
    held = tumbling(lines.where("node IS NOT NULL"), seconds)
    return held.groupBy("node", "window_id").agg(F.count("*").alias("n_events"), F.max("y").alias("y"))


def collect_sequences(lines: DataFrame, keys: list[str], order: list[str], event: str = "event_id") -> DataFrame:
    """keys, events: the events of each sequence in the given order, which collect_list alone would not keep."""
    rows = F.array_sort(F.collect_list(F.struct(*order, event)))
    return lines.groupBy(*keys).agg(F.transform(rows, lambda r: r[event]).alias("events"))


def bigrams(lines: DataFrame, seq: list[str], order: list[str], event: str = "event_id") -> DataFrame:
    """(seq, a, b): each pair of successive events of a sequence."""
    ahead = F.lead(event).over(Window.partitionBy(*seq).orderBy(*order))
    return lines.select(*seq, F.col(event).alias("a"), ahead.alias("b")).where("b IS NOT NULL")


def fixed_count(lines: DataFrame, size: int, keys: list[str], order: list[str]) -> DataFrame:
    """lines with the number of the window of that many successive lines of its key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return lines.withColumn("window_no", F.floor((rn - 1) / size))
