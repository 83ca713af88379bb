"""Feature vectors of sequences in long form: (seq_id, term, value); a missing row is a zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(lines: DataFrame, seq: str = "seq_id", term: str = "event_id") -> DataFrame:
    return lines.groupBy(F.col(seq).alias("seq_id"), F.col(term).alias("term")).agg(F.count("*").alias("value"))


def natural_vocabulary(lines: DataFrame, event: str = "event_id") -> DataFrame:
    """(event_id, col_idx): events in the order of their numeric suffix."""
    number = F.regexp_extract(event, r"([0-9]+)$", 1).cast("int")
    names = lines.select(F.col(event).alias("event_id"), number.alias("n")).distinct()
    every = F.array_sort(F.collect_set(F.struct("n", "event_id")))  # a vocabulary, not rows
    return names.agg(every.alias("v")).select(F.posexplode("v").alias("col_idx", "e")).select("e.event_id", F.col("col_idx").cast("long"))


def doc_frequency(cells: DataFrame) -> DataFrame:
    return cells.where("value > 0").groupBy("term").agg(F.count("*").alias("df"))


def idf(cells: DataFrame, n: int | Column, smooth: bool = False) -> DataFrame:
    """(term, idf): ln(n / (1 + df)), which may be negative; smooth: ln((n + 1) / (df + 1)) + 1."""
    n = F.lit(n) if isinstance(n, int) else n
    value = F.ln((n + 1) / (F.col("df") + 1)) + 1 if smooth else F.ln(n / (1 + F.col("df")))
    return doc_frequency(cells).select("term", "df", value.alias("idf"))


def per_sequence(total: Column) -> Column:
    """An aggregate of a sequence's cells beside each of them: one shuffle, and no second reading of what made the cells. A
    sequence has as many cells as it has different terms."""
    return total.over(Window.partitionBy("seq_id"))


def tf_idf(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Term shares times idf; terms without a weight are dropped (their idf is unknown)."""
    share = F.col("value") / F.when(F.col("total") == 0, 1).otherwise(F.col("total"))
    joined = cells.withColumn("total", per_sequence(F.sum("value"))).join(weights.select("term", "idf"), "term")
    return joined.select("seq_id", "term", (share * F.col("idf")).alias("value"))


def l2_normalized(cells: DataFrame) -> DataFrame:
    """Each sequence scaled to length 1; a zero row stays zero."""
    scaled = F.col("value") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))
    return cells.withColumn("norm", F.sqrt(per_sequence(F.sum(F.col("value") * F.col("value"))))).select("seq_id", "term", scaled.alias("value"))


def column_scaled(cells: DataFrame, n: int, how: str = "std") -> DataFrame:
    """Values over their column's population deviation or maximum over all n sequences (0: 1), zeros counted."""
    mean = F.sum("value") / n
    spread = F.sqrt(F.greatest(F.sum(F.col("value") * F.col("value")) / n - mean * mean, F.lit(0.0))) if how == "std" else F.max("value")
    by = cells.groupBy("term").agg(spread.cast("double").alias("scale"))
    scaled = F.col("value") / F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale"))
    return cells.join(by, "term").select("seq_id", "term", "scale", scaled.alias("value"))


def interval_stats(lines: DataFrame, order: list[str], ts: str = "ts_s") -> DataFrame:
    """(seq_id, mean, std, max, latency) of the gaps between successive lines; a single line has zeros."""
    gap = F.lead(ts).over(Window.partitionBy("seq_id").orderBy(*order)) - F.col(ts)
    stats = lines.select("seq_id", ts, gap.alias("gap")).groupBy("seq_id")
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return stats.agg(
        zero(F.avg("gap")).alias("gap_mean"), zero(F.stddev_pop("gap")).alias("gap_std"), zero(F.max("gap")).alias("gap_max"),
        (F.max(ts) - F.min(ts)).cast("double").alias("latency"),
    )


# --- dense rows: arrays of doubles ---------------------------------------------------------------------------


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def unit(x: Column) -> Column:
    n = norm(x)
    return F.transform(x, lambda v: v / F.when(n == 0, 1.0).otherwise(n))


def minus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def vector_mean(rows: DataFrame, x: str = "x") -> list[float]:
    """Column means; the driver sees one number for each dimension."""
    found = rows.select(F.posexplode(x).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).collect()
    return [r["m"] for r in sorted(found, key=lambda r: r["k"])]


def pooled(tokens: DataFrame, vectors: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """(seq_id, dim, mean, max, weighted) over the occurrences whose token has a vector.

    tokens: (seq_id, term); vectors: (term, dim, v), a row for each dimension; idf: (term, idf), 1.0 where missing.
    A sequence without a known token has no rows. Equal tokens of a sequence are counted before the join.
    """
    held = tokens.groupBy("seq_id", "term").agg(F.count("*").alias("n"))
    held = held.join(idf.select("term", "idf"), "term", "left") if idf is not None else held.withColumn("idf", F.lit(1.0))
    w = F.col("n") * F.coalesce("idf", F.lit(1.0))
    rows = held.join(vectors, "term").groupBy("seq_id", "dim")
    mean = F.sum(F.col("n") * F.col("v")) / F.sum("n")
    return rows.agg(mean.alias("mean"), F.max("v").alias("max"), F.when(F.sum(w) > 0, F.sum(w * F.col("v")) / F.sum(w)).otherwise(mean).alias("weighted"))
