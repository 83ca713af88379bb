"""Decision thresholds on scores. A row is flagged if its score is strictly above the threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.operators.ranks import quantiles, quantiles_by, running_sums


def percentile(df: DataFrame, q: float, col: str = "err") -> float | None:
    return quantiles(df, col, [q])[0]


def mean_sigma(df: DataFrame, k: float = 3.0, col: str = "err") -> float:
    m, s = df.agg(F.avg(col), F.stddev_pop(col)).first()
    return m + k * s


@dataclass(frozen=True)
class Tail:
    """Peaks over threshold by the moments of a generalized Pareto distribution. shape_sign: the published thresholds
    use the negated moment estimate ("reference"); "standard" is the estimate itself."""

    q: float = 0.9
    fpr: float = 1e-3
    fallback: float = 0.995
    least: int = 10
    shape_sign: str = "reference"


def tail_threshold(u: float, share: float, mean: float, var: float, t: Tail) -> float:
    """Threshold from the excesses' mean and population variance, and the share of rows above u."""
    ratio = mean * mean / var
    xi, sigma = 0.5 * (1 - ratio), 0.5 * mean * (ratio + 1)
    xi = -xi if t.shape_sign == "reference" else xi
    if xi == 0:
        return u - sigma * math.log(t.fpr / share)
    return u + sigma / xi * ((t.fpr / share) ** -xi - 1)


def pot(df: DataFrame, t: Tail | None = None, col: str = "err") -> float:
    """Peaks over threshold; with fewer than t.least excesses, or equal ones, the t.fallback quantile."""
    t = t or Tail()
    u, back = quantiles(df, col, [t.q, t.fallback])
    excess = F.when(F.col(col) > u, F.col(col) - u)
    n, over, mean, var = df.agg(F.count(col), F.count(excess), F.avg(excess), F.var_pop(excess)).first()
    if over < t.least or var == 0:
        return back
    return tail_threshold(u, over / n, mean, var, t)


def mode_a(df: DataFrame, t: Tail | None = None, col: str = "err") -> tuple[float, bool]:
    """POT on validation normals, and whether it had to fall back to the 99.5 % quantile."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    back = percentile(df, 0.995, col)
    try:
        theta = pot(df, t, col)
    except (ArithmeticError, ValueError, TypeError):
        return back, True
    if math.isnan(theta) or math.isinf(theta) or theta <= low or theta > 5 * high:
        return back, True
    return theta, False


def candidates(n: int = 200, low: float = 0.8, high: float = 0.999) -> list[float]:
    return [low + (high - low) * k / (n - 1) for k in range(n)]


def best_f1(found: pd.DataFrame) -> tuple[float, float]:
    """The first of rows (value, p, n, p_all, n_all) with the greatest F1 of flagging what is above value, and that F1; p and n:
    anomalies and others that are not above."""
    tp, fp = (found.p_all - found.p).to_numpy(float), (found.n_all - found.n).to_numpy(float)
    f1 = 2 * tp / np.maximum(tp + fp + found.p_all.to_numpy(float), 1)
    k = int(f1.argmax())
    return float(found.value.iloc[k]), float(f1[k])


#: Anomalies and others, to be summed up with quantiles.
LABELS = {"p": "CAST(y = 1 AS LONG)", "n": "CAST(coalesce(y, 0) <> 1 AS LONG)"}


def mode_b(df: DataFrame, col: str = "err", n: int = 200) -> tuple[float, float]:
    """The first of n quantiles of all validation scores with the greatest F1, and that F1; flags are counted by rank."""
    return best_f1(quantiles_by(df, col, candidates(n), [], LABELS))


def mode_a_by(df: DataFrame, by: list[str], t: Tail | None = None, col: str = "err") -> pd.DataFrame:
    """mode_a() for each group: (by, theta, fallback), groups on the driver."""
    t = t or Tail()
    cuts = quantiles_by(df, col, sorted({t.q, t.fallback, 0.995}), by)
    wide = {q: cuts[cuts.q == q].set_index(by).value for q in {t.q, t.fallback, 0.995}}
    params = df.sparkSession.createDataFrame(cuts[cuts.q == t.q].rename(columns={"value": "u"})[[*by, "u"]])
    excess = F.when(F.col(col) > F.col("u"), F.col(col) - F.col("u"))
    got = df.join(F.broadcast(params), by).groupBy(*by).agg(  # a row for each group
        F.count(col).alias("n"), F.count(excess).alias("over"), F.avg(excess).alias("mean"), F.var_pop(excess).alias("var"), F.min(col).alias("low"),
        F.max(col).alias("high"), F.first("u").alias("u"),
    ).toPandas()
    out = []
    for r in got.itertuples(index=False):
        key = tuple(getattr(r, c) for c in by)
        at = key if len(by) > 1 else key[0]
        if r.over < t.least or r.var == 0:
            theta = wide[t.fallback][at]
        else:
            try:
                theta = tail_threshold(r.u, r.over / r.n, r.mean, r.var, t)
            except (ArithmeticError, ValueError):
                theta = math.nan
        failed = bool(math.isnan(theta) or math.isinf(theta) or theta <= r.low or theta > 5 * r.high)
        out.append((*key, float(wide[0.995][at] if failed else theta), failed))
    return pd.DataFrame(out, columns=[*by, "theta", "fallback"])


def mode_b_by(df: DataFrame, by: list[str], col: str = "err", n: int = 200) -> pd.DataFrame:
    """mode_b() for each group: (by, theta, f1), groups on the driver."""
    found = quantiles_by(df, col, candidates(n), by, LABELS)
    return pd.DataFrame([(*(key if isinstance(key, tuple) else (key,)), *best_f1(part)) for key, part in found.groupby(by)], columns=[*by, "theta", "f1"])


def top_fraction(df: DataFrame, fraction: float = 0.05, col: str = "err", tie: str = "seq_id") -> DataFrame:
    """df with flag: the ceil(fraction * n) rows of the largest scores; ties go to the smaller id."""
    n = math.ceil(fraction * df.count())
    ranked = running_sums(df, [F.col(col).desc(), F.col(tie)], {"rn": F.lit(1)})
    return ranked.withColumn("flag", (F.col("rn") <= n).cast("int")).drop("rn")


def nth_largest(df: DataFrame, n: int, col: str = "err") -> float | None:
    """The n-th score from the top, the least one if there are fewer; ranks are running sums of range partitions."""
    ranked = running_sums(df.select(col), [F.col(col).desc()], {"rn": F.lit(1)})
    return ranked.where(F.col("rn") <= n).agg(F.min(col)).first()[0]


def pareto_grid(largest: float, mean: float) -> np.ndarray:
    """Values of shape / scale that the profile is taken at."""
    return np.concatenate([-(1 - np.logspace(-6, -0.01, 200)) / largest, np.logspace(-4, 2, 400) / mean])


def best_pareto(grid: np.ndarray, shape: np.ndarray) -> tuple[float, float]:
    """(shape, scale) where the profile likelihood is greatest; shape: the mean of log1p(g * x) for each g of the grid."""
    with np.errstate(divide="ignore", invalid="ignore"):
        like = -np.log(np.where(grid * shape > 0, shape / grid, np.nan)) - shape - 1
    k = int(np.nanargmax(like))
    return float(shape[k]), float(shape[k] / grid[k])


def fit_pareto(excess: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of a generalized Pareto distribution by maximum likelihood: Grimshaw's profile over one parameter."""
    grid = pareto_grid(excess.max(), excess.mean())
    return best_pareto(grid, np.array([np.log1p(g * excess).mean() for g in grid]))


def log1p_sums(df: DataFrame, grid: np.ndarray, col: str) -> np.ndarray:
    """Sum of log1p(g * col) over all rows for each g; a task adds up its own."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grid))
        for b in batches:
            x = b[col].to_numpy()
            total += [np.log1p(g * x).sum() for g in grid]
        yield pd.DataFrame({"k": np.arange(len(grid)), "v": total})

    made = df.select(col).mapInPandas(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    return made.toPandas().sort_values("k").v.to_numpy()  # a number for each g


def pot_mle(df: DataFrame, p: float = 0.05, q: float = 0.9, col: str = "err") -> float:
    """POT by maximum likelihood on all excesses over the q-quantile; what cannot be fitted falls back to the (1 - p)
    quantile."""
    u = percentile(df, q, col)
    n = df.agg(F.count(col)).first()[0]
    excess = df.where(F.col(col) > u).select((F.col(col) - u).alias("x"))
    over, largest, mean = excess.agg(F.count("x"), F.max("x"), F.avg("x")).first()
    if over < 10:
        return percentile(df, 1 - p, col)
    grid = pareto_grid(largest, mean)
    xi, beta = best_pareto(grid, log1p_sums(excess, grid, "x") / over)
    if not math.isfinite(xi) or beta <= 0:
        return percentile(df, 1 - p, col)
    return u + beta * math.log(over / (n * p)) if abs(xi) < 1e-9 else u + beta / xi * ((over / (n * p)) ** xi - 1)
