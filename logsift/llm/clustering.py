"""Centroid clustering of integer vectors with partial-distance search.

A vector's squared distance to a centroid is added up over blocks of dimensions, those of high variance first. Centroids are
tried in the order of their first block; one whose part is strictly above the best full distance so far is abandoned, and
those that survive all blocks are compared in full, ties to the smaller number. Tasks add up their vectors by cluster, so
that a round sends sums of each task, and the driver sees ``clusters`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import arrow_map, materialize
from logsift.llm.vectors import LIMIT, fixed_point

#: Dimensions of a block, and vectors looked at together.
BLOCK, ROWS = 16, 2048
#: Sums leave a task in parts of so many bits, whose own sums cannot overflow over 2**31 tasks.
LIMB = 32


@dataclass(frozen=True)
class Settings:
    """clusters: centroids, taken from the vectors of smallest sha256 of ``seed:id``; rounds of assignment and update, before
    the last assignment; size: components of a vector; scale: a component x becomes floor(scale * x)."""

    clusters: int = 16
    rounds: int = 3
    size: int = 64
    scale: int = 64
    seed: int = 1


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, the smaller number of equally near ones; order: dimensions,
    those of high variance first. All numbers are exact: components are below 2**27."""
    who, found = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    x, centroids = x[:, order], centroids[:, order]
    blocks = [slice(k, k + BLOCK) for k in range(0, x.shape[1], BLOCK)]
    for a in range(0, len(x), ROWS):
        rows = x[a : a + ROWS]
        head = np.stack([((rows[:, blocks[0]] - c[blocks[0]]) ** 2).sum(1) for c in centroids], 1)
        tries = np.argsort(head, 1, kind="stable")
        best, at = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(centroids))
        for k in range(len(centroids)):
            c = tries[:, k]
            part = head[np.arange(len(rows)), c]
            live = np.flatnonzero(part <= best)
            if not len(live):
                break  # later ones have no smaller parts
            part = part[live]
            for b in blocks[1:]:
                part = part + ((rows[live, b] - centroids[c[live], b]) ** 2).sum(1)
                on = part <= best[live]
                live, part = live[on], part[on]
            better = (part < best[live]) | (c[live] < at[live])
            live, part = live[better], part[better]
            best[live], at[live] = part, c[live]
        who[a : a + ROWS], found[a : a + ROWS] = at, best
    return who, found


def limbs(total: int) -> list[int]:
    """A whole number as parts of LIMB bits, the least first; only the last may be negative."""
    out = []
    while not -(1 << LIMB) < total < 1 << LIMB:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _column(df: DataFrame, name: str) -> int:
    return df.columns.index(name)


def _spread(rows: DataFrame, s: Settings, vec: str) -> np.ndarray:
    """Dimensions by falling variance. Sums of squares in floating point: the order changes no result."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(s.size), np.zeros(s.size)
        for b in batches:
            _, x = fixed_point(b.column(0), s.size, s.scale)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + (x.astype(float) ** 2).sum(0)
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"k": np.arange(s.size), "n": n, "v": sums, "q": squares}))

    made = arrow_map(rows.select(vec), add, "k long, n long, v double, q double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "nvq"])
    got = made.toPandas().sort_values("k")  # a row for each dimension
    n = got.n.clip(1)
    return np.argsort(-(got.q / n - (got.v / n) ** 2).to_numpy(), kind="stable")


def first_centroids(rows: DataFrame, s: Settings, vec: str, vec_id: str) -> np.ndarray:
    """Vectors of the smallest hashes of their ids, by hash; equal ids by components, rows without an id last."""
    i, j = _column(rows, vec_id), _column(rows, vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first few of each task, which Spark then orders."""
        held: list[tuple] = []
        for b in batches:
            kept, x = fixed_point(b.column(j), s.size, s.scale)
            ids = b.column(i).filter(pa.array(kept)).to_pylist()
            keys = [hashlib.sha256(f"{s.seed}:{v}".encode()).hexdigest() if v is not None else "g" for v in ids]  # g: after all digits
            held = sorted([*held, *zip(keys, map(tuple, x.tolist()), strict=True)])[: s.clusters]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([list(v) for _, v in held], pa.list_(pa.int64()))], names=["k", "x"])

    got = arrow_map(rows, run, "k string, x array<long>").orderBy("k", "x").limit(s.clusters).collect()
    return np.array([r["x"] for r in got], np.int64).reshape(-1, s.size)


def _updated(rows: DataFrame, centroids: np.ndarray, order: np.ndarray, s: Settings, vec: str) -> np.ndarray:
    """Centroids after a round: exact floor of the means; empty clusters keep theirs."""
    held = rows.sparkSession.sparkContext.broadcast((centroids, order))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order = held.value
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, object)
        for b in batches:
            _, x = fixed_point(b.column(0), s.size, s.scale)
            who, _ = nearest(x, centroids, order)
            part = np.zeros(centroids.shape, np.int64)
            np.add.at(part, who, x)
            n, total = n + np.bincount(who, minlength=len(n)), total + part  # whole numbers of any size
        found = [(c, k, int(n[c]), place, v) for c in np.flatnonzero(n).tolist() for k in range(s.size) for place, v in enumerate(limbs(int(total[c, k])))]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=["c", "k", "n", "limb", "v"]).astype("int64"))

    made = arrow_map(rows.select(vec), add, "c long, k long, n long, limb long, v long")
    sums, counts = np.zeros(centroids.shape, object), {}
    for r in made.groupBy("c", "k", "limb").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # some numbers for each centroid's component
        sums[r["c"], r["k"]] += r["v"] << (LIMB * r["limb"])
        if r["limb"] == 0:
            counts[r["c"]] = r["n"]
    out = centroids.copy()
    for c, n in counts.items():
        out[c] = [v // n for v in sums[c]]  # floors
    return out


def cluster(rows: DataFrame, settings: Settings | None = None, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """rows whose vector is kept, with cluster, distance (squared), cluster_inertia, inertia, centroid (array of long) and
    centroid_sha256.

    Left out are vectors of another size, null, with a null or non-finite component, or with one that is 2**27 or more after
    scaling, whose distances a long may not hold. Equal vectors get the same cluster; repeated rows stay and count each. Rows
    without an id stay but are first centroids only if there are too few others. With fewer vectors than clusters
    there are as many clusters as vectors; an empty table gives an empty one. Inertias that a long does not hold are null.
    Other columns stay, columns of the added names are replaced.
    """
    s = settings or Settings()
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    rows = rows.select(*[c for c in rows.columns if c not in added])
    order, centroids = _spread(rows, s, vec), first_centroids(rows, s, vec, vec_id)
    for _ in range(s.rounds if len(centroids) else 0):
        centroids = _updated(rows, centroids, order, s, vec)
    at, names, held = _column(rows, vec), [*rows.columns, "cluster", "distance"], rows.sparkSession.sparkContext.broadcast((centroids, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, order = held.value
        for b in batches:
            kept, x = fixed_point(b.column(at), s.size, s.scale)
            if len(x):
                who, found = nearest(x, centroids, order)
                yield pa.RecordBatch.from_arrays([*b.filter(pa.array(kept)).columns, pa.array(who.astype(np.int32)), pa.array(found)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    assigned = materialize(arrow_map(rows, run, f"{fields}, cluster int, distance long"))
    sums = {r["cluster"]: r["v"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("v")).collect()}
    fits = lambda v: int(v) if v < 1 << 63 else None
    named = [(c, fits(v), fits(sum(sums.values())), centroids[c].tolist(), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, v in sorted(sums.items())]
    more = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(more), "cluster").select(*names, *added[2:])  # a row for each cluster
