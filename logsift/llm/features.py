"""Hashed n-gram counts of texts and linear models on them, in numpy inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import LOWER, mix64, ngrams, pieces, text_bytes, arrow_map, word_hash, word_spans

#: Bytes of text, and rows, at a time.
BLOCK, BLOCK_ROWS = 1 << 19, 512
#: Letters keep their lower-case byte, bytes of longer characters stay, all else counts as a blank.
LETTERS = np.where((LOWER >= 97) & (LOWER <= 122) | (np.arange(256) >= 128), LOWER, 32).astype(np.uint8)

Block = tuple[int, np.ndarray, np.ndarray]


def blocks(column: pa.Array) -> Iterator[Block]:
    """(first row, bytes, offsets) of some rows of a text column at a time; no text is cut."""
    data, offsets = text_bytes(column)
    for a, b in pieces(offsets, BLOCK, BLOCK_ROWS):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a number for each byte over each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def byte_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive bytes of a text, and that text."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data) < n:
        return np.zeros(0, np.uint64), text[:0]
    out = np.full(len(data) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * np.uint64(257) + data[k : len(data) - n + 1 + k]
    whole = text[: len(out)] == text[n - 1 :]
    return mix64(out[whole]), text[: len(out)][whole]


def word_grams(data: np.ndarray, offsets: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 1 to most successive words of a text, and that text."""
    starts, ends, texts = word_spans(data, offsets)
    words = word_hash(data, starts, ends)
    got = [ngrams(words, texts, n) for n in range(1, most + 1)]
    return np.concatenate([g for g, _ in got]), np.concatenate([t for _, t in got])


def tally(grams: np.ndarray, texts: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Counts of hashed grams, a row of size buckets for each text."""
    bucket = (grams >> np.uint64(20)).astype(np.int64) % size
    return np.bincount(texts * size + bucket, minlength=rows * size).reshape(rows, size)


def unit(counts: np.ndarray) -> np.ndarray:
    """Roots of counts, scaled to rows of unit length (all zero: left so)."""
    x = counts.astype(np.float32)
    np.sqrt(x, out=x)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x /= np.where(norm == 0, 1, norm)
    return x


def counted(grams: np.ndarray, texts: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Counts of hashed grams, a row of size buckets for each text, scaled to unit length (all zero: left so)."""
    return unit(tally(grams, texts, rows, size))


def hashed_share(id_: Column, share: Column | float, salt: str) -> Column:
    """True for about that share of the ids, always the same ones."""
    return F.pmod(F.xxhash64(F.lit(salt), id_), F.lit(1_000_000)) < F.lit(share) * 1_000_000


def vectors(docs: DataFrame, make: Callable[[np.ndarray, np.ndarray], np.ndarray], label: str) -> tuple[np.ndarray, list]:
    """Feature rows and labels of a bounded sample on the driver; docs has text and the label. Ordered by content, so
    the same rows give the same model however they are partitioned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, data, offsets in blocks(batch.column(0)):
                x = make(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, len(x))], names=["x", "y"])

    kind = docs.schema[label].dataType.simpleString()
    rows = arrow_map(docs.select("text", label), run, f"x binary, y {kind}").toArrow()
    order = sorted(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist(), strict=True), key=lambda r: (r[0], str(r[1])))
    del rows
    x, y = np.zeros((len(order), len(order[0][0]) // 2 if order else 1), np.float16), [r[1] for r in order]
    for k in range(len(order)):  # a row goes as it is copied, so that the sample is not held twice
        x[k], order[k] = np.frombuffer(order[k][0], np.float16), None
    return x, y


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights (features + 1, outputs) of logistic regressions for y in {-1, 1} (rows, outputs), by Adam on all rows."""
    held = np.ones((len(x), x.shape[1] + 1), np.float32)  # the only wide copy
    held[:, :-1] = x
    x = held
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = (weight / weight.sum(0)).astype(np.float32)
    for t in range(1, steps + 1):
        pull = -y * weight / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))
        g = x.T @ pull.astype(np.float32) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def margins_of_sample(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """margins() of half-width rows, widened some at a time."""
    return np.concatenate([margins(x[k : k + BLOCK_ROWS].astype(np.float32), w) for k in range(0, max(1, len(x)), BLOCK_ROWS)])
