"""Ranks, thresholds and metrics of many groups in one pass, against one group at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.operators import metrics, ranks, thresholds


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(1), []
    for g, n in (("a", 700), ("b", 90), ("c", 1), ("d", 40)):
        for i in range(n):
            y = int(rng.random() < 0.2)
            err = float(np.round(rng.gamma(2) + 2 * y, 2 if g != "d" else 0))
            out.append((g, len(out), y, err))
    return [*out, ("e", 9000, 1, None), ("a", 9001, 0, None)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, seq_id long, y int, err double").repartition(5)


def of(rows, g):
    return np.array([(r[3], r[2]) for r in rows if r[0] == g and r[3] is not None])


def test_quantiles_and_sums_below_them(rows, table):
    qs = [0.0, 0.1, 0.5, 0.9, 0.995, 1.0]
    found = ranks.quantiles_by(table, "err", qs, ["g"], thresholds.LABELS)
    assert set(found.g) == {"a", "b", "c", "d"}
    for g, part in found.groupby("g"):
        x, y = of(rows, g).T
        assert np.allclose(part.value, np.quantile(x, qs))
        for v, p, n, p_all, n_all in part[["value", "p", "n", "p_all", "n_all"]].itertuples(index=False):
            assert (p, n, p_all, n_all) == ((x <= v)[y == 1].sum(), (x <= v)[y == 0].sum(), (y == 1).sum(), (y == 0).sum())
    assert len(ranks.quantiles_by(table.limit(0), "err", qs, ["g"])) == 0


def test_quantiles_without_groups(rows, table):
    x = np.array([r[3] for r in rows if r[3] is not None])
    assert np.allclose(ranks.quantiles_by(table, "err", [0.3, 0.77], []).value, np.quantile(x, [0.3, 0.77]))


def test_thresholds_of_each_group(table):
    a = thresholds.mode_a_by(table.where("y = 0"), ["g"]).set_index("g")
    b = thresholds.mode_b_by(table, ["g"]).set_index("g")
    for g in "abd":
        one = table.where(F.col("g") == g)
        theta, fallback = thresholds.mode_a(one.where("y = 0"))
        assert a.theta[g] == pytest.approx(theta) and a.fallback[g] == fallback
        assert (b.theta[g], b.f1[g]) == pytest.approx(thresholds.mode_b(one))


def test_best_f1_is_the_first_of_all_candidates(rows, table):
    x, y = of(rows, "b").T
    thetas = np.quantile(x, thresholds.candidates())
    f1 = [2 * ((x > t) & (y == 1)).sum() / max((x > t).sum() + (y == 1).sum(), 1) for t in thetas]
    assert thresholds.mode_b(table.where("g = 'b'")) == pytest.approx((thetas[int(np.argmax(f1))], max(f1)))


def test_metrics_of_each_group(table):
    for of_scores, name in ((metrics.average_precision, "average_precision"), (metrics.roc_auc, "roc_auc")):
        found = {r["g"]: r[name] for r in of_scores(table.where("err IS NOT NULL"), by=["g"]).collect()}
        for g in "abcd":
            assert found[g] == pytest.approx(of_scores(table.where("err IS NOT NULL").where(F.col("g") == g)).first()[0])
