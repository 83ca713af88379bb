"""Log templates by a prefix tree of fixed depth.

A masked line goes down by its number of tokens, then by its first tokens: tokens without a digit have branches of their
own as long as their parent has room, all others share the wildcard branch. In a leaf, distinct texts are taken in the order of
their first line; one joins the template that it shares most tokens with, if these are enough, and what differs becomes a
wildcard; else it begins a template.

A leaf of many distinct texts is dealt to buckets by hash, each of them clustered alone; then the template sets of two
neighbouring buckets are merged by the same rule, in the order of their first lines, until a leaf has one set. How many buckets
a leaf has follows from its texts alone, so that the result does not depend on partitions or on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import materialize

WILDCARD = "<*>"


@dataclass(frozen=True)
class Tree:
    """similarity: share of tokens that a line and its template have in common, at least; depth: of the tree, root, layer of
    lengths and leaves included; children: branches of a node, its wildcard included; split: distinct texts that a bucket holds, about."""

    similarity: float = 0.5
    depth: int = 4
    children: int = 100
    split: int = 2_000


class Leaf:
    """Templates of texts of one length; place k holds the k-th that began."""

    def __init__(self, similarity: float, size: int) -> None:
        self.similarity, self.size, self.n = similarity, size, 0
        self.code, self.name = {WILDCARD: 0}, [WILDCARD]
        self.held = np.zeros((16, size), np.int32)

    def _coded(self, tokens: list[str]) -> np.ndarray:
        for t in tokens:
            if t not in self.code:
                self.code[t] = len(self.name)
                self.name.append(t)
        return np.array([self.code[t] for t in tokens], np.int32)

    def begin(self, tokens: list[str]) -> int:
        if self.n == len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n] = self._coded(tokens)
        self.n += 1
        return self.n - 1

    def add(self, tokens: list[str]) -> int:
        """The place of the template that the tokens joined; the earliest of equally near ones."""
        v = self._coded(tokens)
        if self.n:
            same = ((self.held[: self.n] == v) & (v > 0)).sum(1)
            best = int(same.argmax())
            if same[best] >= self.similarity * self.size:
                self.held[best, self.held[best] != v] = 0
                return best
        return self.begin(tokens)

    def template(self, place: int) -> str:
        return " ".join(self.name[c] for c in self.held[place])


def tokens_of(masked: Column) -> Column:
    return F.split(masked, " ")


def branch(token: Column) -> Column:
    """What a token is called in the tree, but for a parent without room."""
    return F.when(token.rlike("[0-9]"), WILDCARD).otherwise(token)


def placed(texts: DataFrame, tree: Tree) -> DataFrame:
    """texts (masked, first) with leaf, the path of the leaf that holds each. A node's own branches are the first
    ``children`` - 1 tokens in the order of their first lines; Spark keeps no more of them for each task."""
    tokens = tokens_of(F.col("masked"))
    rows = texts.withColumn("leaf", F.array(F.size(tokens).cast("string")))
    for k in range(max(tree.depth - 3, 0)):
        rows = rows.withColumn("_token", F.coalesce(branch(F.try_element_at(tokens, F.lit(k + 1))), F.lit("")))
        order = Window.partitionBy("leaf").orderBy("_first", "_token")
        own = rows.where(F.col("_token") != WILDCARD).groupBy("leaf", "_token").agg(F.min("first").alias("_first"))
        own = own.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") < tree.children).select("leaf", "_token", F.lit(True).alias("_own"))
        rows = rows.join(own, ["leaf", "_token"], "left")
        rows = rows.withColumn("leaf", F.concat("leaf", F.array(F.when(F.col("_own"), F.col("_token")).otherwise(WILDCARD)))).drop("_token", "_own")
    return rows


def _joined(pdf: pd.DataFrame, text: str, order: list[str], similarity: float) -> tuple[pd.DataFrame, list[int], Leaf]:
    pdf = pdf.sort_values(order)
    texts = [t.split(" ") for t in pdf[text]]
    leaf = Leaf(similarity, len(texts[0]))
    return pdf, [leaf.add(t) for t in texts], leaf


def cluster_texts(texts: DataFrame, tree: Tree) -> DataFrame:
    """(masked, cluster, template) of distinct texts (masked, first); cluster: the first line of all its texts."""
    leaves = materialize(placed(texts, tree))
    sizes = leaves.groupBy("leaf").agg(F.count("*").alias("_n"))
    parts = F.pow(F.lit(2), F.ceil(F.greatest(F.log2(F.col("_n") / tree.split), F.lit(0.0)))).cast("long")
    dealt = leaves.join(sizes.select("leaf", parts.alias("parts")), "leaf").withColumn("bucket", F.pmod(F.xxhash64("masked"), "parts"))
    similarity = tree.similarity

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, place, leaf = _joined(pdf, "masked", ["first", "masked"], similarity)
        began = pdf["first"].groupby(place).transform("first") if len(pdf) else pdf["first"]
        return pdf[["leaf", "parts", "bucket", "masked"]].assign(cluster=began, template=[leaf.template(k) for k in place])

    line = texts.schema["first"].dataType.simpleString()
    found = materialize(dealt.groupBy("leaf", "bucket").applyInPandas(cluster, f"leaf array<string>, parts long, bucket long, masked string, cluster {line}, template string"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The templates of two buckets, each with the one that it became."""
        pdf, place, leaf = _joined(pdf, "template", ["cluster", "template"], similarity)
        began = pdf["cluster"].groupby(place).transform("first")
        return pd.DataFrame({"leaf": pdf["leaf"], "parts": pdf["parts"], "bucket": pdf["bucket"] // 2, "old": pdf["cluster"], "cluster": began, "template": [leaf.template(k) for k in place]})

    most = found.agg(F.max("parts")).first()[0] or 1
    schema = f"leaf array<string>, parts long, bucket long, old {line}, cluster {line}, template string"
    now = found.where("parts > 1").select("leaf", "parts", "bucket", F.col("cluster").alias("begun"), "cluster", "template").distinct() if most > 1 else None
    for k in range(most.bit_length() - 1):
        open_ = now.where(F.col("parts") > (1 << k))
        merged = open_.select("leaf", "parts", "bucket", "cluster", "template").distinct()
        merged = merged.groupBy("leaf", F.floor(F.col("bucket") / 2)).applyInPandas(merge, schema)
        renamed = open_.select("leaf", "begun", F.col("cluster").alias("old")).join(merged, ["leaf", "old"]).drop("old")
        now = materialize(renamed.select(*now.columns).unionByName(now.where(F.col("parts") <= (1 << k))))
    if now is None:
        return found.select("masked", "cluster", "template")
    last = now.select("leaf", F.col("begun").alias("cluster"), F.col("cluster").alias("_cluster"), F.col("template").alias("_template"))
    found = found.join(last, ["leaf", "cluster"], "left")
    return found.select("masked", F.coalesce("_cluster", "cluster").alias("cluster"), F.coalesce("_template", "template").alias("template"))
