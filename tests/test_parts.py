"""What a task holds does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from logsift import session
from logsift.plans import registered

QUERIES, _ = registered()
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["win_bigram_counts", "feat_bigram_l2"])
def test_sessions_are_dealt_to_more_parts_the_more_lines_there_are(spark, monkeypatch, name):
    whole = {tuple(r) for r in QUERIES[name](spark, SF).collect()}
    monkeypatch.setattr(session, "PART_ROWS", 2_000)
    found = QUERIES[name](spark, SF).withColumn("part", F.spark_partition_id()).collect()
    held = {}
    for r in found:
        held.setdefault(r["part"], []).append(tuple(r)[:-1])
    assert {r for rows in held.values() for r in rows} == whole
    assert max(map(len, held.values())) < 4_000


def test_terms_of_all_kinds_are_dealt_again_after_they_are_joined(spark, monkeypatch):
    monkeypatch.setattr(session, "PART_ROWS", 2_000)
    found = QUERIES["feat_combined"](spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in found) < 6_000


def test_each_shard_has_a_part_of_its_own(spark):
    import numpy as np

    from logsift.operators import training

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i % 3, i, rng.normal(size=4).tolist()) for i in range(900)], "fold int, seq_id long, x array<double>")
    dealt = training.deal(rows, "x", "fold", "seq_id", 50).rows
    parts = dealt.select("g", "shard", F.spark_partition_id().alias("part")).distinct().collect()
    assert len(parts) == len({r["part"] for r in parts}) == 18


def test_a_round_sends_the_driver_parameters_only(spark, monkeypatch):
    """Not a row for each number: a list for each block of parameters, summed in the order of shards."""
    import numpy as np

    from logsift.operators import training

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "seq_id long, x array<double>")
    setup = training.Setup(hidden=(3,), epochs=3)
    first = training.fit_networks(rows, [setup], shard=50)[0][0]
    again = training.fit_networks(rows.repartition(7), [setup], shard=50)[0][0]
    monkeypatch.setattr(training, "BLOCK", 10)
    small = training.fit_networks(rows, [setup], shard=50)[0][0]
    for other in (again, small):
        assert all((a == b).all() for x, y in zip(first.layers, other.layers, strict=True) for a, b in zip(x, y, strict=True))


def test_packed_shards_hold_the_same_vectors_in_the_same_order(spark):
    """What each round of training reads is a few rows of bytes for a shard, not a row for each vector."""
    import numpy as np

    from logsift.operators import training

    rows = spark.range(400).selectExpr("id AS seq_id", "id % 2 AS fold", "array(id / 3e0, -id * 1e0, 0.1e0) AS x")
    plain = training.deal(rows, "x", "fold", "seq_id", 50).rows.toArrow()
    found = training.deal(rows, "x", "fold", "seq_id", 50, pack=True).rows.toArrow()
    want = {(g, s): (training.matrix(t), t["held"].to_numpy()) for g, s, t in training.in_shards(iter(plain.to_batches()))}
    got = {(g, s): training.unpacked(t) for g, s, t in training.in_shards(iter(found.to_batches()))}
    assert len(found) == len(got) == 8 and got.keys() == want.keys()
    for k, (m, held) in want.items():
        assert np.array_equal(got[k][0], m) and np.array_equal(got[k][1], held)


def test_features_are_made_by_all_cores_however_small_the_file(spark):
    from logsift.operators import evaluation
    from logsift.session import materialize

    rows = materialize(spark.range(1000).selectExpr("id AS seq_id", "1 AS fold", "array('a', 'b') AS events").coalesce(1))
    dealt = evaluation.spread(rows)
    assert rows.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["seq_id"] for r in dealt.collect()) == list(range(1000))
