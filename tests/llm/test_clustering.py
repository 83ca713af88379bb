"""Clusters against a plain computation in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from logsift.llm.clustering import Settings, cluster, limbs, nearest

SCHEMA = "vec_id long, embedding array<double>, distance string, centroid int"


def plain(rows, s):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == s.size and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(s.scale * x) for x in v]
            if max(map(abs, w)) < 1 << 27:
                kept.append((i, w))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "g", r[1]))
    centroids = [w for _, w in first[: s.clusters]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(s.rounds + 1):
        near = [min((dist(w, c), n) for n, c in enumerate(centroids)) for _, w in kept]
        if k < s.rounds:
            for n in range(len(centroids)):
                mine = [w for (_, w), (_, m) in zip(kept, near, strict=True) if m == n]
                if mine:
                    centroids[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    total = sum(d for d, _ in near) if kept else 0
    inertia = {n: sum(d for d, m in near if m == n) for n in range(len(centroids))}
    fits = lambda v: v if v < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), n, d, fits(inertia[n]), fits(total), sha[n]) for (i, _), (d, n) in zip(kept, near, strict=True))


def found(spark, rows, s, parts=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(parts)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in cluster(df, s).collect())


def test_clusters_with_ties_repeats_and_refused_vectors(spark):
    rng, s = random.Random(1), Settings(clusters=5, rounds=3, size=24)
    rows = [(i, [rng.choice([-0.02, 0.0, 0.013, 0.4]) for _ in range(24)]) for i in range(120)]
    rows += [(7, rows[7][1]), (500, rows[7][1]), (501, rows[7][1]), (None, rows[9][1]), (502, None), (503, []), (504, [1.0] * 23)]
    rows += [(505, [None] + [0.1] * 23), (506, [math.nan] + [0.1] * 23), (507, [math.inf] * 24), (508, [1e300] * 24), (509, [2.0**20] * 24)]
    assert found(spark, rows, s) == plain(rows, s)


def test_few_vectors_and_none(spark):
    s = Settings(clusters=5, rounds=3, size=4)
    rows = [(1, [0.1, 0.2, 0.3, 0.4]), (2, [0.1, 0.2, 0.3, 0.4]), (3, [0.0, 0.0, -1.0, 5.0])]
    assert found(spark, rows, s) == plain(rows, s)
    assert found(spark, [], s) == []
    assert found(spark, [(1, None)], s) == []


def test_sums_beyond_a_long(spark):
    s = Settings(clusters=2, rounds=1, size=64, scale=1)
    rows = [(i, [((-1) ** (i * k)) * (2.0**27 - 1 - i) for k in range(64)]) for i in range(9)]
    got = found(spark, rows, s)
    assert got == plain(rows, s)


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-9, 9, (500, 64)), rng.integers(-9, 9, (16, 64))
    c[7] = c[3]
    who, d = nearest(x, c, rng.permutation(64))
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (who == full.argmin(1)).all() and (d == full.min(1)).all()


@pytest.mark.parametrize("v", [0, 5, -5, 2**32, -(2**32), 2**90 + 17, -(2**90) - 17])
def test_limbs(v):
    assert sum(p << (32 * k) for k, p in enumerate(limbs(v))) == v and all(abs(p) < 1 << 33 for p in limbs(v))
