"""Exact dedup by recipes of content-defined chunks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import ascii_lower, broadcast_if_small, materialize

#: A chunk ends at the first sentence or line end after 256 characters, and is of 4096 at most.
CHUNK = r"(?s).{256,4094}?(?:\n|[.!?] )|.{1,4096}"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """Groups rows whose texts are equal after lower-casing A-Z; of a group the row with the largest id stays.

    Each text becomes a recipe, the ordered list of its chunks' identifiers, in the task that reads it; only recipes
    are shuffled. Texts of different recipes differ. For those of equal recipes the chunks move once, to prove that
    each identifier stands for one content; a text holding an identifier of two contents is compared by its SHA-256
    too. id_bits shortens identifiers, to test that.

    Returns (id_col, keep_id, group_size, kept, text_sha256), one row for each row of docs. A null text counts as
    empty. Null ids lose to others; in a group of null ids only, keep_id is null and each row is kept. Repeated rows of
    the id that stays are all kept. Other columns are ignored; an empty table gives an empty one.
    """
    part = F.xxhash64("c") if id_bits == 64 else F.shiftright(F.xxhash64("c"), 64 - id_bits)
    chunks = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    recipe = F.transform(chunks, lambda c: F.xxhash64(c) if id_bits == 64 else F.shiftright(F.xxhash64(c), 64 - id_bits))
    texts = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(text_col, F.lit(""))).alias("norm"))
    base = materialize(texts.select("id", F.sha2("norm", 256).alias("text_sha256"), recipe.alias("recipe")))

    alike = base.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").where(F.size("recipe") > 0)
    rows = materialize(base.join(alike.select("recipe"), "recipe", "left_semi").select("id", "text_sha256"))
    ids = broadcast_if_small(rows.select("id").distinct())
    moved = texts.join(ids, texts.id.eqNullSafe(ids.id), "left_semi").select(F.explode(chunks).alias("c")).select(part.alias("h"), "c")
    unproved = materialize(moved.distinct().groupBy("h").count().where("count > 1").select("h"))
    key = F.lit(None).cast("string")
    if not unproved.isEmpty():
        holders = base.select("text_sha256", F.explode("recipe").alias("h")).join(unproved, "h", "left_semi").select("text_sha256", F.lit(True).alias("doubt")).distinct()
        base = base.join(holders, "text_sha256", "left")
        key = F.when(F.col("doubt"), F.col("text_sha256"))
    base = base.select("id", "text_sha256", "recipe", F.coalesce(key, F.lit("")).alias("proof"))
    groups = base.groupBy("recipe", "proof").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    out = base.join(groups, ["recipe", "proof"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
