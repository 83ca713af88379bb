"""Hard negatives of anchor vectors by blocked matrix products.

Anchors are numbered and dealt to blocks of at most ``block`` rows, so that what is broadcast at once is bounded however
many there are. For each block, a first pass over all rows multiplies them with the block and keeps each task's best positives
of each anchor; these merge by rank into the anchor's positives. A second pass keeps each task's best negatives within
the score window of each positive, which merge in the same way. Products of integers below 2**53 are exact in float64; where
larger components could exceed that, they are taken in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import arrow_map, discard, materialize
from logsift.llm.vectors import fixed_point
from logsift.operators.ranks import running_sums

#: Rows multiplied with anchors at a time, and anchors.
ROWS, ANCHORS = 1024, 1024
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    """positives of an anchor and negatives of a positive, at most; window: a negative's score is at least window[0] /
    window[1] of its positive's and at most that; size and scale as in fixed_point(); block: anchors broadcast at once."""

    positives: int = 5
    negatives: int = 5
    window: tuple[int, int] = (80, 100)
    size: int = 64
    scale: int = 256
    block: int = 16_384


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of x, as longs."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


class Best:
    """The best few (score, id) of each of n groups, higher scores first and ties by smaller id; order and batches do not
    matter. Places that are not taken have the score _NONE."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.score, self.id = most, np.full((n, most), _NONE), np.zeros((n, most), np.int64)

    def least(self) -> np.ndarray:
        """Scores below these cannot enter any more."""
        return self.score[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(group)
        old_g, old_k = np.nonzero(self.score[touched] > _NONE)
        old_g = touched[old_g]
        group, score, ids = np.append(old_g, group), np.append(self.score[old_g, old_k], score), np.append(self.id[old_g, old_k], ids)
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        held = rank < self.most
        self.score[group[held], rank[held]], self.id[group[held], rank[held]] = score[held], ids[held]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, k = np.nonzero(self.score > _NONE)
        return g, self.score[g, k], self.id[g, k]


def prepared(rows: DataFrame, s: Settings, vec: str, vec_id: str, label: str) -> DataFrame:
    """(id, label, x array<long>) of the rows that take part."""
    rows = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, x = fixed_point(b.column(2), s.size, s.scale)
            mask = pa.array(kept)
            values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, s.size, dtype=np.int32), pa.array(x.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask), values], names=["id", "label", "x"])

    return materialize(arrow_map(rows, run, "id long, label long, x array<int>"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _tiles(batches: Iterator[pa.RecordBatch], ids: np.ndarray, labels: np.ndarray, a: np.ndarray) -> Iterator[tuple]:
    """(first anchor, scores, whether labels agree, ids of the rows) of blocks of anchors by rows; an anchor's own id scores
    _NONE."""
    for b in batches:
        for at in range(0, len(b), ROWS):
            part = b.slice(at, ROWS)
            mine, lab, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), a.shape[1])
            for first in range(0, len(a), ANCHORS):
                to = slice(first, first + ANCHORS)
                scores = products(a[to], x)
                scores[ids[to, None] == mine] = _NONE
                yield first, scores, labels[to, None] == lab, mine


def _merged(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best rows of each key, ranked: tasks have sent at most ``most`` of each."""
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= most)


def _block(rows: DataFrame, anchors: pa.Table, s: Settings) -> DataFrame:
    """Results of one block of anchors (id, label, x)."""
    spark = rows.sparkSession
    a = (anchors["id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["x"].combine_chunks(), s.size))
    held = spark.sparkContext.broadcast(a)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = held.value
        best = Best(len(ids), s.positives)
        for first, scores, same, mine in _tiles(batches, ids, labels, x):
            g, k = np.nonzero(same & (scores > _NONE) & (scores >= best.least()[first : first + len(scores), None]))
            best.add(g + first, scores[g, k], mine[k])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], names=["a", "score", "other"])

    top = _merged(arrow_map(rows, positives, "a long, score long, other long"), ["a"], s.positives).toArrow()  # a few for each anchor
    p_score, p_id = (np.full((len(a[0]), s.positives), v, np.int64) for v in (_NONE, 0))
    at = top["a"].to_numpy(), top["rank"].to_numpy() - 1
    p_score[at], p_id[at] = top["score"].to_numpy(), top["other"].to_numpy()
    low, high = s.window
    least = np.where(p_score > _NONE, -((-low * np.maximum(p_score, 0)) // high), 1)  # of a window; scores below 0 have none
    tops = np.where(p_score >= 0, p_score, 0)
    windows = spark.sparkContext.broadcast((least, np.where(p_score >= 0, tops, -1)))

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, x = held.value
        least, tops = windows.value
        best = [Best(len(ids), s.negatives) for _ in range(s.positives)]
        for first, scores, same, mine in _tiles(batches, ids, labels, x):
            mask, to = ~same & (scores > _NONE), slice(first, first + len(scores))
            for j, b in enumerate(best):
                g, k = np.nonzero(mask & (scores <= tops[to, j, None]) & (scores >= np.maximum(least[to, j], b.least()[to])[:, None]))
                b.add(g + first, scores[g, k], mine[k])
        for j, b in enumerate(best):
            g, score, other = b.rows()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), j)), pa.array(score), pa.array(other)], names=["a", "j", "score", "other"])

    found = _merged(arrow_map(rows, negatives, "a long, j long, score long, other long"), ["a", "j"], s.negatives)
    n = len(a[0])
    every = pa.table({"a": np.repeat(np.arange(n), s.positives), "j": np.tile(np.arange(s.positives), n), "anchor_id": np.repeat(a[0], s.positives), "positive_id": p_id.ravel(), "positive_score": p_score.ravel()})
    names = spark.createDataFrame(every.filter(pa.array(p_score.ravel() > _NONE)))
    out = found.join(F.broadcast(names), ["a", "j"])  # positives of one block
    return out.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine(rows: DataFrame, is_anchor: str, settings: Settings | None = None, vec: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor: an SQL condition on ``id``, the row's id.

    Rows without a label, an id or a vector of the size, or with a null or non-finite component take no part, nor do those with
    a component of 2**27 or more after scaling, whose scores a long may not hold. A positive or negative is a row
    with another id than the anchor's; repeated rows count each, and a repeated anchor's results repeat. Positives of
    negative score have an empty window. An empty table, and one without anchors, give an empty one. Other columns are ignored.
    """
    s = settings or Settings()
    held = prepared(rows, s, vec, vec_id, label)
    numbered = materialize(running_sums(held.where(is_anchor), [F.col("id"), F.col("label"), F.col("x")], {"rn": F.lit(1)}).withColumn("block", F.floor((F.col("rn") - 1) / s.block)))
    last = numbered.agg(F.max("block")).first()[0]
    out = None
    for k in range(-1 if last is None else last + 1):
        anchors = numbered.where(F.col("block") == k).select("id", "label", "x").toArrow()  # at most s.block rows
        found = materialize(_block(held, anchors, s))
        out = found if out is None else out.unionByName(found)
    discard(numbered)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
