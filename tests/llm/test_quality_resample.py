import math
import random
from collections import Counter

import numpy as np
import pytest

from logsift.llm import quality_resample as qr
from logsift.llm.common import materialize


def test_target_like_rows_are_kept(make, spark):
    rng = random.Random(1)
    text = lambda words: " ".join(rng.choice(words) for _ in range(40))
    good, bad = ["alpha", "beta", "gamma", "delta"], ["###", "$$$", "zzz", "qqq"]
    rows = [(i, text(good if i % 4 else bad)) for i in range(400)] + [(None, text(good)), (7, None), (8, "")]
    target = spark.createDataFrame([(i,) for i in range(0, 200) if i % 4] + [(None,)], "doc_id long")
    got = qr.resample(make(rows), target, qr.Settings(fraction=0.75)).collect()
    again = qr.resample(make(rows[::-1], parts=2), target, qr.Settings(fraction=0.75)).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == -(-len(rows) * 3 // 4)
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got) == sorted((str(r["doc_id"]), r["kept"]) for r in again)
    assert sum(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] > 8 and r["doc_id"] % 4 == 0) <= 5
    assert {r["log_weight"] for r in got if r["n_grams"] == 0} == {0.0}


def test_without_target_all_weights_are_zero(make, spark):
    got = qr.resample(make([(1, "a b"), (2, "c")]), spark.createDataFrame([], "doc_id long")).collect()
    assert {r["log_weight"] for r in got} == {0.0}
    assert qr.resample(make([]), spark.createDataFrame([], "doc_id long")).count() == 0


@pytest.mark.parametrize("values", [[1.0] * 5, [3.0, 1.0, 2.0, 2.0, -7.5, 1e9, -1e9], [0.1 * k for k in range(50)]])
def test_kth_largest(spark, values):
    keys = materialize(spark.createDataFrame([(v,) for v in values], "key double"))
    for k in range(1, len(values) + 1):
        if k % 7 in (0, 1):
            assert qr.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_weights_noise_and_cut_against_a_plain_computation(make, spark):
    rng = random.Random(9)
    words = ["ab", "cd", "ef", "gh", "ij"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "ab " * 5000)]
    chosen = set(range(0, 60, 3))
    s = qr.Settings(buckets=64, fraction=0.5)

    def buckets(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        return Counter(qr._buckets(data, np.array([0, len(data)]), s.buckets)[0].tolist())

    raw, target = Counter(), Counter()
    for i, text in rows:
        raw += buckets(text)
        target += buckets(text) if i in chosen else Counter()
    share = lambda c, b: (c[b] + 1) / (c.total() + s.buckets)
    want = {i: sum(n * math.log(share(target, b) / share(raw, b)) for b, n in buckets(t).items()) for i, t in rows}
    got = qr.resample(make(rows), spark.createDataFrame([(i,) for i in chosen], "doc_id long"), s).collect()
    assert {r["doc_id"]: r["log_weight"] for r in got} == pytest.approx(want)
    assert {r["doc_id"]: r["n_grams"] for r in got} == {i: buckets(t).total() for i, t in rows}
    assert all(-5 < r["gumbel_key"] - r["log_weight"] < 40 for r in got)
    edge = sorted((r["gumbel_key"] for r in got), reverse=True)[math.ceil(s.fraction * len(rows)) - 1]
    assert [r["kept"] for r in got] == [r["gumbel_key"] >= edge for r in got]


def test_ties_at_the_border_all_stay(make, spark):
    rows = [(1, "a b")] * 4 + [(None, "a b")]
    got = qr.resample(make(rows), spark.createDataFrame([(1,)], "doc_id long"), qr.Settings(fraction=0.3)).collect()
    assert sum(r["kept"] for r in got if r["doc_id"] == 1) in (0, 4) and sum(r["kept"] for r in got) >= 1
