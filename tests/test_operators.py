"""Operators against numpy and brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.functions import parsing
from logsift.operators import features, metrics, models, ranks, splits, thresholds
from logsift.sources import logs


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_parsers_of_lists(spark):
    df = table(spark, [("[E5, E22]",), ("[]",), ("['E5', \"E22\", ]",), ("x",), ("[1.0, x]",), ("[1.5, 2]",), (None,)], "s string")
    rows = df.select(parsing.token_list(F.col("s")).alias("t"), parsing.event_list(F.col("s")).alias("e"), parsing.float_list(F.col("s")).alias("f")).collect()
    assert [list(r["t"] or []) for r in rows[:2]] == [["E5", "E22"], []]
    assert list(rows[2]["e"]) == ["E5", "E22"] and list(rows[3]["e"]) == []
    assert list(rows[4]["f"]) == [] and list(rows[5]["f"]) == [1.5, 2.0]


def test_header_format(spark):
    lines = table(spark, [("- 10 n1 disk is  full",), ("bad",)], "value string")
    rows = logs.parse_lines(lines, "<label> <ts> <node> <content>").collect()
    assert [tuple(r) for r in rows] == [("-", "10", "n1", "disk is  full")]


def test_templates_are_shared_by_like_lines(spark):
    lines = [(1, "open file a.txt ok"), (2, "open file b.txt ok"), (3, "close 12 10.0.0.1"), (4, "close 13 10.0.0.2"), (5, "one two three four five")]
    found = {r["line_id"]: r["template"] for r in logs.mine_templates(table(spark, lines, "line_id long, content string")).collect()}
    assert found[1] == found[2] == "open file <*> ok" and found[3] == found[4] == "close <num> <ip>" and found[5] == "one two three four five"


def test_quantiles_equal_numpy(spark):
    values = [5.0, 1.0, 1.0, 7.5, 3.0, 3.0, 9.0, None]
    got = ranks.quantiles(table(spark, [(v,) for v in values], "err double"), "err", [0.0, 0.33, 0.5, 0.95, 1.0])
    assert got == pytest.approx(list(np.quantile([v for v in values if v is not None], [0.0, 0.33, 0.5, 0.95, 1.0])))
    assert ranks.quantiles(table(spark, [], "err double"), "err", [0.5]) == [None]


def test_running_sums_over_all_tasks(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 37) % 1000)
    rows = ranks.running_sums(df, [F.col("k")], {"s": F.col("k")}).orderBy("k").collect()
    assert [r["s"] for r in rows] == list(np.cumsum(range(1000)))


def test_shuffled_rank_is_a_permutation_in_each_group(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    rows = ranks.shuffled_rank(df, 1, ["id"], ["y"]).collect()
    for y in (0, 1):
        got = sorted(r["rn"] for r in rows if r["y"] == y)
        assert got == list(range(1, len(got) + 1))


def test_fold_sizes_follow_ntile(spark):
    df = spark.range(103).withColumn("y", F.lit(0))
    sizes = sorted((r["fold"], r["count"]) for r in splits.kfold(df, 10, 5, ["id"]).groupBy("fold").count().collect())
    assert sizes == [(k, 11 if k <= 3 else 10) for k in range(1, 11)]


def test_stratified_roles_are_disjoint_and_training_is_normal(spark):
    df = spark.range(300).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    rows = splits.stratified(df, 5, 1, ["id"]).collect()
    assert len(rows) == len({(r["fold"], r["id"]) for r in rows}) == 1500
    assert not [r for r in rows if r["role"] == "train" and r["y"] == 1]


@pytest.mark.parametrize("ties", [False, True])
def test_average_precision_and_auc_equal_brute_force(spark, ties):
    rng = np.random.default_rng(3)
    err = rng.integers(0, 8, 200).astype(float) if ties else rng.random(200)
    y = (rng.random(200) < 0.2).astype(int)
    df = table(spark, [(i, float(e), int(v)) for i, (e, v) in enumerate(zip(err, y, strict=True))], "seq_id long, err double, y int")
    pos, neg = err[y == 1], err[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for t in sorted(set(err), reverse=True):
        recall = (pos >= t).mean()
        ap += (recall - before) * (pos >= t).sum() / (err >= t).sum()
        before = recall
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    assert metrics.average_precision(df).first()[0] == pytest.approx(ap)


def test_metrics_without_positives_are_zero(spark):
    df = table(spark, [(1, 0.5, 0, 0)], "seq_id long, err double, y int, flag int")
    row = metrics.precision_recall(metrics.confusion(df)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert metrics.roc_auc(df).first()[0] == 0.0


def test_published_fold_scores_follow_from_their_counts(spark):
    cells = table(spark, [(47, 691, 940, 13065)], "tp long, fp long, fn long, tn long")
    row = metrics.precision_recall(cells).first()
    assert row["precision"] == pytest.approx(47 / 738) and row["recall"] == pytest.approx(47 / 987)


def test_threshold_falls_back_on_few_or_constant_scores(spark):
    few = table(spark, [(i, float(i)) for i in range(20)], "seq_id long, err double")
    assert thresholds.pot(few) == pytest.approx(np.quantile(np.arange(20.0), 0.995))
    same = table(spark, [(i, 2.0) for i in range(500)], "seq_id long, err double")
    assert thresholds.pot(same) == 2.0
    assert thresholds.mode_a(same)[1]


def test_pareto_tail_with_the_standard_sign_meets_its_rate():
    rng = np.random.default_rng(1)
    xi = 0.3
    x = ((1 - rng.random(400_000)) ** -xi - 1) / xi
    u = np.quantile(x, 0.9)
    e = x[x > u] - u
    theta = thresholds.tail_threshold(u, len(e) / len(x), e.mean(), e.var(), thresholds.Tail(shape_sign="standard"))
    assert (x > theta).mean() == pytest.approx(1e-3, rel=0.3)
    negated = thresholds.tail_threshold(u, len(e) / len(x), e.mean(), e.var(), thresholds.Tail())
    assert (x > negated).mean() > 5e-3
    shape, scale = thresholds.fit_pareto(e[:20_000])
    assert shape == pytest.approx(xi, abs=0.05)


def test_mode_b_takes_the_first_best_candidate(spark):
    rng = np.random.default_rng(5)
    err = np.concatenate([rng.random(300), 0.7 + rng.random(60)])
    y = np.r_[np.zeros(300, int), np.ones(60, int)]
    theta, f1 = thresholds.mode_b(table(spark, [(i, float(e), int(v)) for i, (e, v) in enumerate(zip(err, y, strict=True))], "seq_id long, err double, y int"))
    best = max(2 * ((err > t) & (y == 1)).sum() / ((err > t).sum() + 60) for t in np.quantile(err, thresholds.candidates()))
    assert f1 == pytest.approx(best)


def test_unit_length_keeps_zero_rows(spark):
    cells = table(spark, [(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)], "seq_id long, term string, value double")
    assert sorted(r["value"] for r in features.l2_normalized(cells).collect()) == [0.0, 0.6, 0.8]


def test_idf_of_a_term_in_every_sequence_is_negative(spark):
    cells = table(spark, [(1, "a", 1), (2, "a", 1), (2, "b", 1)], "seq_id long, term string, value long")
    got = {r["term"]: r["idf"] for r in features.idf(cells, 2).collect()}
    assert got["a"] == pytest.approx(np.log(2 / 3)) and got["b"] == pytest.approx(0.0)


def test_pooling_ignores_unknown_tokens(spark):
    tokens = table(spark, [(1, "a"), (1, "a"), (1, "b"), (1, "z"), (2, "z")], "seq_id long, term string")
    vectors = table(spark, [("a", 0, 1.0), ("b", 0, 4.0)], "term string, dim int, v double")
    rows = features.pooled(tokens, vectors).collect()
    assert [(r["seq_id"], r["mean"], r["max"]) for r in rows] == [(1, 2.0, 4.0)]


def test_pca_residual_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) @ np.diag([5, 3, 1, 0.5, 0.2, 0.1])
    df = table(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "seq_id long, x array<double>")
    rows = df.withColumn("err", models.fit_pca(df, 2).residual(F.col("x"))).orderBy("seq_id").collect()
    c = x - x.mean(0)
    p = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose([r["err"] for r in rows], np.linalg.norm(c - c @ p.T @ p, axis=1))


def test_robust_pca_finds_both_parts():
    rng = np.random.default_rng(2)
    low = rng.normal(size=(100, 3)) @ rng.normal(size=(3, 40))
    sparse = np.where(rng.random((100, 40)) < 0.05, 10.0, 0.0)
    got = models.robust_pca(low + sparse)
    assert got.error < 1e-7 and np.linalg.norm(got.low - low) / np.linalg.norm(low) < 1e-3
    assert np.allclose(got.low + got.sparse, low + sparse, atol=1e-4)


def test_detectors_rank_outliers_first():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 4))
    far = rng.normal(size=(20, 4)) + 6
    forest, one = models.fit_forest(x), models.fit_one_class(x)
    for score in (forest.scores, one.scores):
        assert score(far).min() > np.quantile(score(x), 0.9)
    net = models.fit_autoencoder(x, (3, 2, 3), epochs=30)
    assert np.median(net.errors(far)) > np.median(net.errors(x)) and net.losses[-1] <= net.losses[0]


def test_smallest_rank():
    assert models.smallest_rank(np.array([9.0, 0.5, 0.5])) == 2 and models.smallest_rank(np.zeros(3)) == 1


def test_scans_are_pruned_and_no_plan_is_cartesian(spark):
    from logsift.views import table as read

    plan = read(spark, "/root/testdata/sf0.001", "events").select("user_id", "ts")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan or "ReadSchema: struct<user_id:bigint,ts:timestamp_ntz>" in plan
