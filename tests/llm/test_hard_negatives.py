"""Hard negatives against a plain computation in whole numbers."""

import math
import random

import numpy as np

from logsift.llm import hard_negatives
from logsift.llm.hard_negatives import Settings, mine, products

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int"


def plain(rows, s, is_anchor):
    held = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and len(v) == s.size and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(s.scale * x) for x in v]
            if max(map(abs, w)) < 1 << 27:
                held.append((i, w, lab))
    out = []
    for a, w, lab in held:
        if not is_anchor(a):
            continue
        scores = sorted((-sum(p * q for p, q in zip(w, x, strict=True)), i, other == lab) for i, x, other in held if i != a)
        for p, pid, _ in [r for r in scores if r[2]][: s.positives]:
            fit = [(-n, nid) for n, nid, same in scores if not same and s.window[0] * -p <= s.window[1] * -n <= s.window[1] * -p]
            out += [(a, pid, k + 1, nid, -p, n) for k, (n, nid) in enumerate(fit[: s.negatives])]
    return sorted(out)


def found(spark, rows, s, parts=4):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, mine(df, "id % 10 = 0", s).collect()))


def test_blocks_ties_repeats_and_refused_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng, s = random.Random(1), Settings(size=8, block=5)
    rows = [(i, [rng.choice([-0.3, 0.0, 0.25, 0.5]) for _ in range(8)], 0 if rng.random() < 0.4 else rng.randrange(4)) for i in range(200)]
    rows += [(i, rows[20][1], lab) for i in range(300, 330) for lab in (0, 1)]  # many ties
    rows += [(20, rows[20][1], rows[20][2]), (500, None, 1), (510, rows[3][1], None), (None, rows[3][1], 1), (520, [None] * 8, 1), (530, [math.nan] * 8, 1)]
    rows += [(540, [0.5] * 7, 1), (550, [1e200] * 8, 1), (-10, rows[5][1], 2)]
    got, want = found(spark, rows, s), plain(rows, s, lambda i: i % 10 == 0)
    assert got == want and len(got) > 200


def test_few_rows_and_none(spark):
    s = Settings(size=2)
    rows = [(10, [1.0, 1.0], 1), (11, [1.0, 0.9], 1), (12, [0.9, 0.9], 2), (13, [-1.0, -1.0], 1), (20, [1.0, 0.0], 3)]
    assert found(spark, rows, s) == plain(rows, s, lambda i: i % 10 == 0)
    assert found(spark, [], s) == [] and found(spark, rows[1:4], s) == []


def test_products_are_exact_beyond_double():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-(2**27) + 1, 2**27, (5, 64)), rng.integers(-(2**27) + 1, 2**27, (7, 64))
    want = [[sum(int(p) * int(q) for p, q in zip(r, c, strict=True)) for c in x] for r in a]
    assert products(a, x).tolist() == want
