"""Validation and grades of the evaluation in time are of all rows."""

import numpy as np
from pyspark.sql import functions as F

from logsift.operators import evaluation, splits


def test_all_earlier_anomalies_validate(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 4 != 0).cast("int").alias("y"), F.col("id").alias("t"))
    roles = {(r["y"], r["role"]): r["count"] for r in splits.chronological(df, ["id"], "t").groupBy("y", "role").count().collect()}
    last = 4 * (8_000 - 1)  # of the validation normals
    early = sum(1 for i in range(last) if i % 4)
    assert early > 20_000 and roles == {(0, "train"): 7_000, (0, "val"): 1_000, (0, "test"): 2_000, (1, "val"): early, (1, "test"): 30_000 - early}


def test_all_other_anomalies_of_a_fold_validate(spark):
    df = spark.range(44_000).select("id", (F.col("id") % 4 != 0).cast("int").alias("y"))
    rows = splits.stratified(df, 3, 1, ["id"]).where("y = 1").groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in rows} == {"test": 33_000, "val": 66_000}


def test_balanced_cells_are_of_all_rows(spark):
    rng, rows = np.random.default_rng(8), []
    for fold, share in ((1, 0.1), (2, 0.8), (3, 0.3)):
        for i in range(700):
            y, role = int(rng.random() < share), "val" if rng.random() < 0.4 else "test"
            if (fold, role, y) != (3, "test", 1):
                rows.append((fold, i, role, y, float(rng.gamma(2) + 2 * y)))
    scores = spark.createDataFrame(rows, "fold int, seq_id long, role string, y int, err double").repartition(4)
    got = {(r["fold"], r["mode"], r["view"]): r for r in evaluation.grades(scores, ["fold"], drawn=False).collect()}
    drawn = {(r["fold"], r["mode"], r["view"]): r for r in evaluation.grades(scores, ["fold"]).collect()}
    assert got.keys() == drawn.keys() and (3, "A", "balanced") not in got
    for key, r in got.items():
        if key[2] == "natural":
            assert r.asDict() == drawn[key].asDict()
        else:
            whole = got[key[0], key[1], "natural"]
            odd, normal = whole["tp"] + whole["fn"], whole["fp"] + whole["tn"]
            assert (r["tp"], r["fn"], r["fp"] + r["tn"]) == (whole["tp"], whole["fn"], min(odd, normal))
            assert abs(r["fp"] - whole["fp"] * min(odd, normal) / normal) <= 0.5
