"""Quality rules: counts of words, signs and repeats, and a calibrated n-gram classifier learned from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import SPACE, broadcast_if_small, materialize, mix64, ngrams, arrow_map, numbered, word_spans
from logsift.llm.features import blocks, byte_grams, counted, hashed_share, logistic, margins, per_text, vectors, word_grams

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Settings:
    """sample: labelled texts of each class that are learned from, about (the bound of what the driver holds).
    A text fails with fewer words than least_words, with more than repeat_percent of its words in repeated windows, or
    with a probability of quality under threshold."""

    sample: int = 1500
    word_buckets: int = 4096
    char_buckets: int = 4096
    window: int = 8
    least_words: int = 20
    repeat_percent: int = 30
    threshold: float = 0.25


@dataclass(frozen=True)
class Model:
    weights: np.ndarray | None  # null: nothing to learn from, all texts have probability 1
    slope: float
    shift: float
    settings: Settings


def _features(data: np.ndarray, offsets: np.ndarray, s: Settings) -> np.ndarray:
    rows = len(offsets) - 1
    words = counted(*word_grams(data, offsets, 2), rows, s.word_buckets)
    chars = counted(*byte_grams(data, offsets, 3), rows, s.char_buckets)
    return np.concatenate([words, chars], 1)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """docs: (doc_id, text); labels: (doc_id, quality 0 or 1). Of several labels of an id the least counts, nulls do not.

    Three quarters of the sample fit the regression, the rest its probabilities (Platt's method). With labels of one
    class only, nothing is learned.
    """
    s = settings or Settings()
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(None, 1.0, 0.0, s)
    share = F.when(F.col("quality") == 1, s.sample / counts[1]).otherwise(s.sample / counts[0])
    known = materialize(known.where(hashed_share(F.col("doc_id"), share, "quality")))
    rows = docs.select("doc_id", "text").join(broadcast_if_small(known), "doc_id")
    rows = rows.withColumn("y", F.col("quality") + F.when(hashed_share(F.col("doc_id"), 0.25, "calibration"), 2).otherwise(0))
    x, y = vectors(rows, lambda d, o: _features(d, o, s), "y")
    y = np.array(y, np.int64)
    fit, held = np.flatnonzero(y < 2), np.flatnonzero(y >= 2)
    if len(set(y[fit] % 2)) < 2:
        return Model(None, 1.0, 0.0, s)
    sign = (2 * (y % 2) - 1)[:, None]
    weight = (1 / np.bincount(y[fit] % 2))[y[fit] % 2][:, None]
    w = logistic(x[fit], sign[fit], weight)
    slope, shift = 1.0, 0.0
    if len(set(y[held] % 2)) == 2:
        m = margins(x[held].astype(np.float32), w)
        fitted = logistic(m / 10, sign[held], np.ones_like(m), steps=400, rate=0.1, decay=1e-3)
        slope, shift = float(fitted[0, 0]) / 10, float(fitted[1, 0])
    return Model(w, slope, shift, s)


def repeated_words(words: np.ndarray, texts: np.ndarray, window: int, rows: int) -> np.ndarray:
    """Words of each text in windows of that many words which the text has twice or more. words: numbers from numbered(), which
    stand for random ones here, so that no text can be made for windows to meet."""
    words = np.random.default_rng().integers(0, 1 << 63, int(words.max(initial=0)) + 1, np.uint64)[words]
    starts = np.flatnonzero(texts[: max(0, len(texts) - window + 1)] == texts[window - 1 :]) if len(texts) >= window else np.zeros(0, np.int64)
    grams, owners = ngrams(words, texts, window)
    _, which, count = np.unique(mix64(grams ^ mix64(owners.astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = starts[count[which] > 1]
    cover = np.bincount(twice, minlength=len(texts) + 1)[: len(texts) + 1] - np.bincount(twice + window, minlength=len(texts) + 1)[: len(texts) + 1]
    return np.bincount(texts[np.cumsum(cover)[: len(texts)] > 0], minlength=rows)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    text = np.searchsorted(offsets[1:], starts, "right")
    starts, text = starts[text < rows], text[text < rows]
    ends = np.minimum(np.append(starts[1:], len(data)), offsets[text + 1])
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=inside[1:])
    some = inside[ends] > inside[starts]
    starts, ends, text = starts[some], ends[some], text[some]
    ends = ends - (data[ends - 1] == 10)
    which, held = numbered(data, starts, ends)
    _, first = np.unique(text * max(len(held), 1) + which, return_index=True)
    return np.bincount(text, minlength=rows) - np.bincount(text[first], minlength=rows)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality_prob).

    A null or empty text has no words and fails. Each row is judged alone; ids may be null or repeat; other columns are
    ignored; an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_prob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        s = model.settings
        for batch in batches:
            for a, data, offsets in blocks(batch.column(1)):
                rows = len(offsets) - 1
                starts, ends, texts = word_spans(data, offsets)
                n = np.bincount(texts, minlength=rows)
                repeats = repeated_words(numbered(data, starts, ends)[0], texts, s.window, rows)
                failed = (n < s.least_words) | (100 * repeats > s.repeat_percent * n)
                p = np.ones(rows)
                if model.weights is not None:
                    m = margins(_features(data, offsets, s), model.weights)[:, 0].astype(np.float64)
                    p = 1 / (1 + np.exp(-np.clip(model.slope * m + model.shift, -30, 30)))
                chars = per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets)
                counts = [n, chars, per_text(SYMBOLS[data], offsets), duplicate_lines(data, offsets), repeats]
                more = [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (p >= s.threshold)), pa.array(p)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, rows), *more], names=names)

    kind = docs.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in names[1:6])
    return arrow_map(docs, run, f"id {kind}, {longs}, base_failed boolean, kept boolean, quality_prob double").withColumnRenamed("id", id_col)
