"""Whole evaluations against numpy."""

import os

import numpy as np
import pytest

from logsift.operators import evaluation, thresholds, training
from logsift.plans import detectors
from logsift.views import vec64

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_folds_fit_flag_and_grade_as_numpy_does(spark):
    got = sorted(detectors.eval_pca_folds(spark, SF).collect())
    x = {r["seq_id"]: np.array(r["x"]) for r in vec64(spark, SF).collect()}
    roles = detectors.fold_roles(spark, SF).collect()
    assert len(got) == detectors.FOLDS and sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in got) == len(x)
    for r in got:
        part = {role: [(x[q["seq_id"]], q["y"]) for q in roles if q["fold"] == r["fold"] and q["role"] == role] for role in ("train", "val", "test")}
        fit = np.array([v for v, _ in part["train"]])
        assert all(y == 0 for _, y in part["train"])
        mean = fit.mean(0)
        basis = np.linalg.svd(fit - mean, full_matrices=False)[2][:6]
        err = lambda rows: np.array([np.linalg.norm(v - mean - (v - mean) @ basis.T @ basis) for v, _ in rows])
        normal = [(float(e),) for e in err([q for q in part["val"] if q[1] == 0])]
        theta, fallback = thresholds.mode_a(spark.createDataFrame(normal, "err double"))
        e, y = err(part["test"]), np.array([q for _, q in part["test"]])
        flag = (e > theta).astype(int)
        cells = [int(((flag == f) & (y == t)).sum()) for f, t in ((1, 1), (1, 0), (0, 1), (0, 0))]
        assert [r["tp"], r["fp"], r["fn"], r["tn"]] == cells and r["fallback"] == fallback
        tp, fp, fn, _ = cells
        assert (r["precision"], r["recall"]) == pytest.approx((tp / max(tp + fp, 1), tp / max(tp + fn, 1)), abs=1e-6)
        above = [(np.sum(e[y == 1] >= s) / np.sum(e >= s)) for s in e[y == 1]]
        assert r["average_precision"] == pytest.approx(np.mean(above), abs=1e-6)
        pairs = (e[y == 1][:, None] > e[y == 0]) + (e[y == 1][:, None] == e[y == 0]) / 2
        assert r["roc_auc"] == pytest.approx(pairs.mean(), abs=1e-6)


def test_k_is_chosen_on_validation_rows_with_mode_a(spark):
    got = {r["k"]: (r["f1"], r["chosen"]) for r in detectors.sel_pca_k(spark, SF).collect()}
    x = {r["seq_id"]: np.array(r["x"]) for r in vec64(spark, SF).collect()}
    roles = [r for r in detectors.fold_roles(spark, SF).collect() if r["fold"] == 1]
    part = lambda role: (np.array([x[r["seq_id"]] for r in roles if r["role"] == role]), np.array([r["y"] for r in roles if r["role"] == role]))
    (fit, _), (val, y) = part("train"), part("val")
    v = np.linalg.svd(fit - fit.mean(0), full_matrices=False)[2]
    want = {}
    for k in got:
        z = val - fit.mean(0)
        err = np.linalg.norm(z - z @ v[:k].T @ v[:k], axis=1)
        theta, _ = thresholds.mode_a(spark.createDataFrame([(float(e),) for e in err[y == 0]], "err double"))
        flag = err > theta
        want[k] = 2 * (flag & (y == 1)).sum() / max(flag.sum() + (y == 1).sum(), 1)
    assert {k: f1 for k, (f1, _) in got.items()} == pytest.approx(want, abs=1e-6)
    best = max(want.values())
    assert [k for k, (_, chosen) in got.items() if chosen] == [min(k for k in want if want[k] >= best - 1e-9)]


def test_features_of_a_fold_know_its_training_words_only(spark):
    rows = [(0, 1, ["a", "b", "a"]), (0, 2, ["b", "z"]), (0, 3, []), (1, 1, ["a", "c"]), (1, 4, None), (2, 5, ["a"])]
    table = spark.createDataFrame(rows, "fold int, seq_id long, events array<string>").repartition(3)
    vectors = {(0, "a"): [1.0, 2.0], (0, "b"): [-1.0, 0.5], (1, "a"): [3.0, 0.0], (1, "c"): [0.0, 4.0]}
    weights = {(0, "a"): 2.0, (0, "b"): 0.5, (1, "a"): -1.0, (1, "c"): 1.0}
    made = evaluation.FoldFeatures(
        spark.createDataFrame([(f, t, k, v) for (f, t), w in vectors.items() for k, v in enumerate(w)], "group int, term string, dim int, v double"),
        spark.createDataFrame([(f, t, w) for (f, t), w in weights.items()], "fold int, term string, idf double"),
    )
    for kind in ("mean", "mean_max", "idf"):
        got = {(r["fold"], r["seq_id"]): r for r in made.transform(table, kind).collect()}
        assert len(got) == len(rows)
        for f, i, events in rows:
            known = [t for t in events or [] if (f, t) in vectors]
            v, w = np.array([vectors[f, t] for t in known]).reshape(-1, 2), np.array([weights[f, t] for t in known])
            if kind == "idf" and w.sum() > 0:
                want = (v * w[:, None]).sum(0) / w.sum()
            else:
                want = v.mean(0) if known else np.zeros(2)
            if kind == "mean_max":
                want = np.concatenate([want, v.max(0) if known else np.zeros(2)])
            want = want / (np.linalg.norm(want) or 1)
            r = got[f, i]
            assert np.allclose(r["x"], want) and (r["n_tokens"], r["n_oov"]) == (len(events or []), len(events or []) - len(known))


def test_what_a_fold_learns_is_of_its_own_rows(spark):
    rows = [(f, i, ["a", "b"] + (["only"] if f == 1 else [])) for f in (0, 1) for i in range(12)]
    made = evaluation.fit_features(spark.createDataFrame(rows, "fold int, seq_id long, events array<string>"), training.Words(dims=4, epochs=1))
    terms, vectors, weights = (made.tables()[1][k] for k in range(3))
    assert terms == ["a", "b", "only"] and vectors.shape == (3, 4) and set(made.tables()[0][0]) == {"a", "b"}
    assert np.allclose(weights, np.log(12 / 13))


def test_grades_of_both_modes_and_views(spark):
    rng, rows = np.random.default_rng(3), []
    for fold in (1, 2):
        for i in range(900):
            y, role = int(rng.random() < 0.15), "val" if rng.random() < 0.4 else "test"
            rows.append((fold, i, role, y, float(rng.gamma(2) + 3 * y)))
    scores = spark.createDataFrame(rows, "fold int, seq_id long, role string, y int, err double").repartition(4)
    got = {(r["fold"], r["mode"], r["view"]): r for r in evaluation.grades(scores, ["fold"]).collect()}
    assert len(got) == 8
    for fold in (1, 2):
        one = scores.where(f"fold = {fold} AND role = 'val'")
        thetas = {"A": thresholds.mode_a(one.where("y = 0"))[0], "B": thresholds.mode_b(one)[0]}
        y, err = np.array([(r[3], r[4]) for r in rows if r[0] == fold and r[2] == "test"]).T
        for mode, theta in thetas.items():
            r, even = got[fold, mode, "natural"], got[fold, mode, "balanced"]
            assert r["theta"] == pytest.approx(theta)
            cells = [int(((err > theta) == f)[y == t].sum()) for f, t in ((True, 1), (True, 0), (False, 1), (False, 0))]
            assert [r["tp"], r["fp"], r["fn"], r["tn"]] == cells
            assert even["tp"] == r["tp"] and even["fn"] == r["fn"] and even["fp"] + even["tn"] == r["tp"] + r["fn"] and even["fp"] <= r["fp"]


def test_every_seed_is_fitted_and_the_ensemble_is_their_mean(spark):
    nets = training.fit_networks(detectors.normals(spark, SF), [training.Setup(seed=s) for s in detectors.SEEDS])[0]
    assert len({n.losses[0] for n in nets}) == len(detectors.SEEDS)
    rows = detectors.held_rows(spark, SF).collect()
    want = np.mean([n.errors(np.array([r["x"] for r in rows])) for n in nets], axis=0)
    got = {r["seq_id"]: r["err"] for r in detectors.model_seed_ensemble(spark, SF).collect()}
    assert all(got[r["seq_id"]] == pytest.approx(w, abs=1e-4) for r, w in zip(rows, want, strict=True))
    assert {r["seed"] for r in detectors.eval_seeds(spark, SF).collect()} == {0, *detectors.SEEDS}
