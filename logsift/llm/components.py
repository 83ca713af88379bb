"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node reachable.

    Distributed union-find by alternating large and small stars: each round hangs a node's larger neighbours, then its
    smaller ones, on the smallest; rounds grow with the logarithm of the component's size. A node of very many edges is
    never gathered: its minimum is aggregated before the shuffle and its edges are spread by a join.
    Nulls and loops are ignored; an empty table gives an empty one.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, seen = materialize(e), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.withColumnRenamed("m", "v"))
        before, e = e, materialize(small.distinct())
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    out = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node within two edges. Nodes of one
    label are connected; connected ones may have several labels. A table to be discarded."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    low = materialize(both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m")))
    far = both.join(low.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("component"))
    out = materialize(far.withColumnRenamed("u", "node"))
    discard(low)
    return out
