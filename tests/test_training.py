"""Fits over shards against fits in one piece."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.operators import models, training
from logsift.operators.training import Setup, Words

SETUPS = [Setup((6, 3, 6), seed=1, epochs=12, batch=32), Setup((4,), alpha=1e-2, seed=2, epochs=5, batch=64)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = np.tanh(rng.normal(size=(600, 2)) @ rng.normal(size=(2, 8))) + 0.05 * rng.normal(size=(600, 8))
    return [(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)]


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "seq_id long, fold int, x array<double>").repartition(parts)


def shards_of(spark, rows, size):
    """(held, vectors) of each shard, with what the library says of where a row belongs."""
    n = -(-len(rows) // size)
    where = spark.createDataFrame([(r[0],) for r in rows], "id long").select("id", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(n)).alias("s"), (F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(10)) == 0).alias("h")).collect()
    place = {r["id"]: (r["s"], r["h"]) for r in where}
    out = []
    for s in range(n):
        mine = sorted(r for r in rows if place[r[0]][0] == s)
        out.append((np.array([place[r[0]][1] for r in mine], bool), np.array([r[2] for r in mine])))
    return out


def test_one_shard_is_trained_as_a_whole(spark, rows):
    got = training.fit_networks(table(spark, rows, 5), SETUPS, "fold")
    assert sorted(got) == [0, 1]
    for fold, nets in got.items():
        (held, x), = shards_of(spark, [r for r in rows if r[1] == fold], 10_000)
        for s, net in zip(SETUPS, nets, strict=True):
            want = training.fit_whole(x - x.mean(0), held, s).network(x.mean(0))
            assert np.allclose(net.losses, want.losses) and np.allclose(net.errors(x), want.errors(x), atol=1e-9)
    assert training.fit_networks(table(spark, [], 1), SETUPS) == {}


def test_shards_are_averaged_after_each_epoch(spark, rows):
    s = SETUPS[0]
    got = training.fit_networks(table(spark, rows, 5), [s], shard=200)[0][0]
    again = training.fit_networks(table(spark, rows[::-1], 2), [s], shard=200)[0][0]
    parts, x = shards_of(spark, rows, 200), np.array([r[2] for r in rows])
    assert len(parts) == 3
    mean, state, losses = x.mean(0), training.begin(8, s), []
    for k in range(s.epochs + 1):
        if k:
            losses.append(sum(training.loss(state, m[h] - mean) for h, m in parts) / sum(m[h].size for h, m in parts))
        after = []
        for shard, (h, m) in enumerate(parts):
            one = training.State(state.sizes, state.flat.copy(), state.steps)
            training.epoch(one, m[~h] - mean, s, k, shard)
            after.append((int((~h).sum()), one))
        n = sum(c for c, _ in after)
        state.flat, state.steps = sum(c * o.flat for c, o in after) / n, sum(c * o.steps for c, o in after) / n
    assert np.allclose(got.losses, losses) and losses[-1] < losses[0]
    assert got.losses == again.losses and all((a[0] == b[0]).all() for a, b in zip(got.layers, again.layers, strict=True))


def test_scores_are_the_mean_over_a_groups_networks(spark, rows):
    rng = np.random.default_rng(1)
    net = lambda: models.Network(rng.normal(size=8), [(rng.normal(size=(8, 3)), rng.normal(size=3)), (rng.normal(size=(3, 8)), rng.normal(size=8))])
    nets = {0: [net() for _ in range(5)], 1: [net()]}
    got = training.score_networks(table(spark, [*rows, (900, 0, None), (901, 7, rows[0][2])], 3), nets, "fold").collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = None if r["seq_id"] >= 900 else np.mean([m.errors(np.array([r["x"]]))[0] for m in nets[r["fold"]]])
        assert r["err"] == (want if want is None else pytest.approx(want))


def sequences(spark, n, parts):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [f"{'ab'[(i // 2) % 2]}{k}" for k in rng.integers(0, 6, 12)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq_id long, fold int, events array<string>").repartition(parts)


def vectors(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["group"], r["term"]), {})[r["dim"]] = r["v"]
    return {k: np.array([v[d] for d in sorted(v)]) for k, v in out.items()}


@pytest.mark.parametrize("shard", [1000, 40])
def test_word_vectors_are_stable_and_know_which_words_meet(spark, shard):
    s = Words(dims=8, epochs=20, sample=1.0)
    rows, df = sequences(spark, 240, 3)
    got, again = vectors(training.fit_words(df, s, "fold", shard=shard)), vectors(training.fit_words(sequences(spark, 240, 7)[1], s, "fold", shard=shard))
    assert set(got) == {(f, f"{c}{k}") for f in (0, 1) for c in "ab" for k in range(6)} and all(len(v) == 8 for v in got.values())
    assert all((got[k] == again[k]).all() for k in got)
    cos = lambda p, q: p @ q / np.linalg.norm(p) / np.linalg.norm(q)
    for f in (0, 1):
        near = np.mean([cos(got[f, f"{c}{i}"], got[f, f"{c}{j}"]) for c in "ab" for i in range(6) for j in range(i)])
        far = np.mean([cos(got[f, f"a{i}"], got[f, f"b{j}"]) for i in range(6) for j in range(6)])
        assert near > far + 0.5
    assert training.fit_words(df.limit(0), s).count() == 0


def test_words_of_one_shard_are_trained_in_its_order(spark):
    s = Words(dims=4, epochs=2)
    rows, df = sequences(spark, 60, 3)
    got = vectors(training.fit_words(df.drop("fold"), s))
    terms = sorted({t for r in rows for t in r[2]})
    ids, seqs = np.array([terms.index(t) for r in rows for t in r[2]]), np.repeat(np.arange(60), 12)
    v = training.first_vectors(len(terms), s)
    for k in range(2):
        v = training.word_epoch(v, ids, seqs, np.bincount(ids).astype(float), s, k, 0)
    assert all(np.allclose(got[0, t], v[0, k], atol=1e-12) for k, t in enumerate(terms))


@pytest.mark.parametrize("shard", [10_000, 150])
def test_one_class_holds_its_share_of_the_rows(spark, rows, shard):
    found = training.fit_one_class_rows(table(spark, rows, 4), nu=0.05, features=64, shard=shard)
    x = np.array([r[2] for r in rows])
    assert abs((found.scores(x) > 0).mean() - 0.05) < 0.01
    if shard > len(rows):
        want = models.fit_one_class(x, 0.05, 64)
        assert np.allclose(found.a, want.a, atol=1e-9) and abs(found.rho - want.rho) < 1e-9
    assert found.scores(x + 9).mean() > found.scores(x).mean()
