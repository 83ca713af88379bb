"""Evaluation of flags and scores against labels (y = 1: anomaly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.ranks import running_sums, running_sums_by

CELLS = {"tp": (1, 1), "fp": (1, 0), "fn": (0, 1), "tn": (0, 0)}


def confusion(df: DataFrame, by: list[str] | None = None, flag: str = "flag") -> DataFrame:
    cells = [F.count_if((F.col(flag) == f) & (F.col("y") == y)).alias(name) for name, (f, y) in CELLS.items()]
    return (df.groupBy(*by) if by else df).agg(*cells)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall(cells: DataFrame) -> DataFrame:
    """cells with precision, recall and f1, 0 where they are not defined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def _by_score(df: DataFrame, col: str, descending: bool, by: list[str]) -> DataFrame:
    """(by, score, p, n, cp, cn): positives and negatives of each distinct score of a group, and their running sums."""
    groups = df.groupBy(*by, F.col(col).alias("score")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    order, sums = [F.col("score").desc() if descending else F.col("score")], {"cp": F.col("p"), "cn": F.col("n")}
    return running_sums_by(groups, by, order, sums) if by else running_sums(groups, order, sums)


def average_precision(df: DataFrame, col: str = "err", by: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores, falling, of the recall's step times the precision; a row for each group."""
    rows = _by_score(df, col, True, by or [])
    step = F.col("p") * F.col("cp").cast("double") / (F.col("cp") + F.col("cn"))
    return rows.groupBy(*(by or [])).agg(ratio(F.sum(step), F.sum("p")).alias("average_precision"))


def roc_auc(df: DataFrame, col: str = "err", by: list[str] | None = None) -> DataFrame:
    """Share of pairs of an anomaly and a normal that scores order rightly; ties count half; a row for each group."""
    rows = _by_score(df, col, False, by or [])
    right = F.col("p") * (F.col("cn") - F.col("n") + F.col("n") / 2.0)
    return rows.groupBy(*(by or [])).agg(ratio(F.sum(right), F.sum("p").cast("double") * F.sum("n")).alias("roc_auc"))
