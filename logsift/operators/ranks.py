"""Ranks, running sums and exact quantiles of whole tables, without sorting one in a single task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import materialize

#: Hexadecimal digits of an MD5 key that make a bucket.
DIGITS = 3


def shuffle_key(seed: int | str, *ids: str) -> Column:
    """A seeded pseudo-random order of rows that any engine can compute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def shuffled_rank(df: DataFrame, seed: int | str, ids: list[str], within: list[str] | None = None, name: str = "rn") -> DataFrame:
    """df with the rank (from 1) of each row in the seeded order of its ids, in each group of ``within``.

    Rows are counted by the first digits of their key; a window ranks each such bucket alone, however large the group.
    """
    within = within or []
    keyed = df.withColumn("_key", shuffle_key(seed, *ids)).withColumn("_bucket", F.substring("_key", 1, DIGITS))
    counts = keyed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*within, "_bucket").orderBy("_key", *ids)
    ranked = keyed.join(ahead, [*within, "_bucket"]).withColumn(name, F.row_number().over(inside) + F.col("_ahead"))
    return ranked.drop("_key", "_bucket", "_ahead")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over all rows up to this one in the given order, itself included.

    Rows are dealt to tasks by ranges of the order; each task adds up its own and what the ranges before it hold.
    """
    spread = df.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    spread = materialize(spread)
    totals = spread.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    ahead = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_a_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = spread.join(F.broadcast(ahead), "_part").withColumns({k: F.sum(f"_{k}").over(inside) + F.col(f"_a_{k}") for k in sums})
    return out.drop("_part", *[f"_{k}" for k in sums], *[f"_a_{k}" for k in sums])


def quantiles(df: DataFrame, col: str, qs: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation (what numpy and quantile_cont give); nulls are ignored, none: nulls."""
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    values = materialize(values)
    total = values.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(qs)
    places = [(total - 1) * q for q in qs]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    summed = running_sums(values, [F.col("v")], {"upto": F.col("n")})
    at = F.filter(F.array(*[F.lit(p) for p in wanted]), lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
    found = {r["p"]: r["v"] for r in summed.select("v", F.explode(at).alias("p")).collect()}  # two rows for each q at most
    low = [found[int(p)] for p in places]
    high = [found[min(int(p) + 1, total - 1)] for p in places]
    return [a + (b - a) * (p - int(p)) for a, b, p in zip(low, high, places, strict=True)]


def running_sums_by(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """running_sums() within each group: tasks hold ranges of (group, order), so that a group of any size spreads over them.
    Rows of a null group are left out."""
    if not by:
        return running_sums(df, order, sums)
    out = materialize(running_sums(df, [*map(F.col, by), *order], {f"_r_{k}": v for k, v in sums.items()} | {"_row": F.lit(1)}).withColumns({f"_o_{k}": v for k, v in sums.items()}))
    first = F.min_by(F.struct(*[(F.col(f"_r_{k}") - F.col(f"_o_{k}")).alias(k) for k in sums]), "_row")
    starts = out.groupBy(*by).agg(first.alias("_start"))
    kept = [c for c in df.columns if c not in sums]
    return out.join(starts, by).select(*kept, *[(F.col(f"_r_{k}") - F.col(f"_start.{k}")).alias(k) for k in sums])


def quantiles_by(df: DataFrame, col: str, qs: list[float], by: list[str], carry: dict[str, str] | None = None) -> pd.DataFrame:
    """(by, q, value) on the driver: exact quantiles of each group, as quantiles() gives them; groups, whose number is that of
    configurations or folds, come to the driver, rows do not. carry: names and SQL of numbers of rows; with each quantile comes
    their sum over the group's rows that are not above it, and as ``<name>_all`` over all. Nulls are ignored.
    """
    carry = carry or {}
    held = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("at"))
    values = held.agg(F.count("*").alias("value_rows"), *[F.sum(F.expr(c)).alias(k) for k, c in carry.items()])
    summed = running_sums_by(values.withColumn("upto", F.col("value_rows")), by, [F.col("at")], {"upto": F.col("value_rows")} | {k: F.col(k) for k in carry})
    summed = materialize(summed)
    totals = summed.groupBy(*by).agg(F.max("upto").alias("n"), *[F.max_by(k, "upto").alias(f"{k}_all") for k in carry]).toPandas()
    totals = totals[totals.n.notna()]
    names, keys = [*carry], [tuple(r) for r in totals[by].itertuples(index=False)] if by else [()] * len(totals)
    place = {k: i for i, k in enumerate(keys)}
    q = np.array(qs)
    exact = [(n - 1) * q for n in totals.n] if len(totals) else []
    wanted = [np.unique(np.concatenate([np.floor(p), np.minimum(np.floor(p) + 1, n - 1)]).astype(np.int64)) for p, n in zip(exact, totals.n, strict=True)]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, part in b.groupby(by, sort=False, dropna=False) if by else [((), b)]:
                w = wanted[place[tuple(key)]]
                lo, hi = np.searchsorted(w, part["upto"] - part["value_rows"]), np.searchsorted(w, part["upto"])
                row = np.repeat(np.arange(len(part)), hi - lo)
                if len(row):
                    at = np.concatenate([np.arange(a, z) for a, z in zip(lo, hi, strict=True)])
                    yield pd.DataFrame({"g": place[tuple(key)], "rank": w[at], **{c: part[c].to_numpy()[row] for c in ("at", *names)}})

    fields = "".join(f", `{k}` {summed.schema[k].dataType.simpleString()}" for k in names)
    found = summed.select(*by, "at", "value_rows", "upto", *names).mapInPandas(pick, f"g long, rank long, at double{fields}").toPandas()  # two rows for each quantile at most
    out = []
    for g, part in found.groupby("g"):
        rank = part.set_index("rank")
        low, high = np.floor(exact[g]).astype(np.int64), np.minimum(np.floor(exact[g]) + 1, totals.n[g] - 1).astype(np.int64)
        a, b = rank.loc[low, "at"].to_numpy(), rank.loc[high, "at"].to_numpy()
        value = a + (b - a) * (exact[g] - low)
        row = {c: [keys[g][i]] * len(q) for i, c in enumerate(by)} | {"q": q, "value": value}
        for k in names:
            row[k] = np.where(value >= b, rank.loc[high, k].to_numpy(), rank.loc[low, k].to_numpy())
            row[f"{k}_all"] = totals[f"{k}_all"][g]
        out.append(pd.DataFrame(row))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[*by, "q", "value", *names, *[f"{k}_all" for k in names]])
