"""Fits and scores that cover all rows, on tables larger than the row samples that they were once taken from."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from logsift.operators import models, thresholds
from logsift.plans import registered

QUERIES, _ = registered()


def test_word_vectors_know_the_tokens_of_the_last_node(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i, at, "rare" if i == 5_100 else "seen", f'{{"k": {i % 100}}}', 1.0) for i in range(5_101)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, props string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["word"] for r in QUERIES["feat_w2v_fit"](spark, str(tmp_path)).collect()}
    assert got == {f"seen_{k}" for k in range(6)} | {f"rare_{5_100 % 100 % 6}"}


def test_pareto_tail_is_fitted_on_every_excess(spark):
    rows = spark.range(0, 1_050_000, 1, 8).select(F.col("id").alias("seq_id"), (F.pow(1 - (F.col("id") + 0.5) / 1_050_000, F.lit(-0.3)) - 1).alias("err"))
    x = np.array([r["err"] for r in rows.select("err").toLocalIterator()])
    u = np.quantile(x, 0.9)
    e = x[x > u] - u
    assert len(e) > 100_000
    xi, beta = thresholds.fit_pareto(e)
    assert abs(thresholds.pot_mle(rows) - (u + beta / xi * ((len(e) / (len(x) * 0.05)) ** xi - 1))) < 1e-9


def test_decomposition_of_partitioned_rows_equals_numpy(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 12)) + np.where(rng.random((400, 12)) < 0.05, 10.0, 0.0)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "seq_id long, x array<double>").repartition(5)
    for centre in (False, True):
        want, got = models.robust_pca(m - m.mean(0) * centre), models.robust_pca_rows(rows, center=centre)
        assert abs(got.iterations - want.iterations) <= 1 and got.rank == want.rank and got.error < 1e-7
        assert got.sparse_cells(1e-3) == (np.abs(want.sparse) > 1e-3).sum()
        assert np.allclose(got.gram_of_low(), want.low.T @ want.low, atol=1e-2)
        err = [r["err"] for r in got.sparse_norms().orderBy("seq_id").collect()]
        assert np.allclose(err, np.linalg.norm(want.sparse, axis=1), atol=1e-4)
        k = 3  # later directions carry next to nothing
        basis = np.linalg.svd(want.low, full_matrices=False)[2][:k]
        m = want.low + want.sparse
        left = [r["err"] for r in got.low_residuals(k).orderBy("seq_id").collect()]
        assert np.allclose(left, np.linalg.norm(m - m @ basis.T @ basis, axis=1), atol=1e-3)


def test_transductive_scores_cover_every_held_row(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5_300, 2)) @ rng.normal(size=(2, 6))
    rows = [(5 * i, [float(v) for v in r], 9 if i % 100 == 0 else 1) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["model_rpca_transductive"](spark, str(tmp_path)).groupBy("score").count().collect()
    assert {r["score"]: r["count"] for r in got} == {"sparse": 5_300, "subspace": 5_300}


def test_decomposition_and_grids_see_rows_beyond_the_samples(spark, tmp_path):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(6_400, 2)) @ rng.normal(size=(2, 16))
    x[rng.random(x.shape) < 0.02] += 9
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(10_000_000 + 5 * i, [float(v) for v in r + (i % 40 == 0) * 30 * rng.normal(size=16)], 9 if i % 40 == 0 else 1) for i, r in enumerate(x[:5_200])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    single = np.array([np.float32(r) for i, r in enumerate(x) if i % 5], float)
    want = models.robust_pca(single)
    got = QUERIES["model_rpca"](spark, str(tmp_path)).first()
    assert len(single) > 5_000 and got["rank"] == want.rank and abs(got["iterations"] - want.iterations) <= 1
    assert abs(got["sparse_cells"] - (np.abs(want.sparse) > 1e-6).sum()) <= 50
    test = np.array([np.float32(r[1]) for r in rows if r[2] == 9 or r[0] % 5 == 0], float)
    y = np.array([r[2] == 9 for r in rows if r[2] == 9 or r[0] % 5 == 0])
    assert len(test) > 5_000
    z, p = test - single.mean(0), np.linalg.svd(single - single.mean(0), full_matrices=False)[2][:2]
    err = np.linalg.norm(z - z @ p.T @ p, axis=1)
    flag = err > np.quantile(err, 0.95)
    swept = QUERIES["diag_k_sweep"](spark, str(tmp_path)).collect()
    f1 = {r["k"]: r["f1"] for r in swept if r["method"] == "pca"}
    low = want.low.T @ want.low
    basis = np.linalg.eigh(low)[1][:, ::-1][:, :2]
    robust = np.linalg.norm(test - test @ basis @ basis.T, axis=1)
    above = robust > np.quantile(robust, 0.95)
    found = next(r for r in swept if r["method"] == "rpca" and r["k"] == 2)
    assert abs(found["f1"] - 2 * (above & y).sum() / (above.sum() + y.sum())) < 0.02
    assert abs(found["sparse_share"] - found["sparse_cells"] / single.size) < 1e-6 and found["final_error"] < 1e-7
    assert len(f1) == 14 and abs(f1[2] - 2 * (flag & y).sum() / (flag.sum() + y.sum())) < 2e-6
