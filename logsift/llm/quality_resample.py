"""Quality by importance resampling: documents are sampled in proportion to how much likelier their hashed n-grams are
under a model of target text than under a model of all text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import broadcast_if_small, materialize, arrow_map
from logsift.llm.features import blocks, word_grams


@dataclass(frozen=True)
class Settings:
    """buckets: of hashed words and word pairs. fraction: of the rows that is sampled. seed: of the Gumbel noise."""

    buckets: int = 10_000
    fraction: float = 0.85
    seed: int = 42


def _buckets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    grams, texts = word_grams(data, offsets, 2)
    return (grams >> np.uint64(20)).astype(np.int64) % size, texts


def _counts(docs: DataFrame, size: int) -> DataFrame:
    """(bucket, raw, target): grams of all rows, and of the target rows; docs has (text, target). Each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            chosen = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, data, offsets in blocks(batch.column(0)):
                bucket, texts = _buckets(data, offsets, size)
                raw += np.bincount(bucket, minlength=size)
                target += np.bincount(bucket[chosen[a + texts]], minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])

    made = arrow_map(docs, run, "bucket long, raw long, target long")
    return made.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the column key; the driver sees 4096 counts at a time. keys must be materialized."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low is not None and low < high:
        width = (high - low) / 4096
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(4095)) if width > 0 else F.lit(0)
        inside = keys.where(F.col("key").between(low, high)).groupBy(at.alias("at"))
        found = inside.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.desc("low")).collect()
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        low, high = r["low"], r["high"]
    return low


def resample(docs: DataFrame, target: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_grams, log_weight, gumbel_key, kept), one row for each row of docs.

    target: the ids (column id_col) of target rows. log_weight is the log-likelihood ratio of the text's grams under the
    target's and the whole corpus's bucket frequencies (each bucket counted once more); Gumbel noise, drawn from the id and
    the seed, is added, and the largest settings.fraction of the keys are kept (without replacement; ties at the border
    all stay). A null or empty text has weight 0. Rows of equal or null ids share their noise. With no target rows all weights
    are 0. Other columns are ignored; an empty table gives an empty one. Counts cover all rows.
    """
    s = settings or Settings()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = broadcast_if_small(materialize(target.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()).withColumn("target", F.lit(True)))
    marked = docs.join(chosen, "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    rows = sorted((r["bucket"], r["raw"], r["target"]) for r in _counts(marked, s.buckets).collect())  # settings.buckets rows
    raw, wanted = (np.array([r[k] for r in rows], np.float64) if rows else np.zeros(s.buckets) for k in (1, 2))
    ratio = np.log((wanted + 1) / (wanted + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    held = docs.sparkSession.sparkContext.broadcast(ratio if wanted.any() else np.zeros(s.buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = held.value
        for batch in batches:
            for a, data, offsets in blocks(batch.column(1)):
                bucket, texts = _buckets(data, offsets, s.buckets)
                n = np.bincount(texts, minlength=len(offsets) - 1)
                weight = np.bincount(texts, ratio[bucket], len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(n)), pa.array(n), pa.array(weight)], names=["id", "n_grams", "log_weight"])

    weighed = arrow_map(docs, weigh, f"id {docs.schema['id'].dataType.simpleString()}, n_grams long, log_weight double")
    u = (F.pmod(F.xxhash64(F.lit(s.seed), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = materialize(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(u))))
    edge = kth_largest(scored, int(np.ceil(s.fraction * scored.count())))
    kept = F.col("key") >= F.lit(edge if edge is not None else 0.0)
    return scored.select(F.col("id").alias(id_col), "n_grams", "log_weight", F.col("key").alias("gumbel_key"), kept.alias("kept"))
