"""Splits of sequences into folds and samples, by seeded MD5 ranks: exact sizes, no position, the same in every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.ranks import shuffled_rank


def _sizes(df: DataFrame, by: str) -> dict:
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}


def tile(rn: Column, n: Column, k: int) -> Column:
    """Fold (from 1) of rank rn among n rows: the first n mod k folds hold one row more."""
    small, extra = F.floor(n / k), n % k
    inside = rn - 1 - extra * (small + 1)
    return F.when(rn <= extra * (small + 1), F.floor((rn - 1) / (small + 1))).otherwise(extra + F.floor(inside / F.greatest(small, F.lit(1)))) + 1


def _with_sizes(df: DataFrame, by: str) -> DataFrame:
    sizes = _sizes(df, by)
    pairs = [F.lit(x) for kv in sizes.items() for x in kv]
    return df.withColumn("n_class", F.create_map(*pairs)[F.col(by)] if pairs else F.lit(0))


def kfold(df: DataFrame, k: int, seed: int, ids: list[str], by: str = "y") -> DataFrame:
    """df with fold 1 to k, dealt in each class alone."""
    ranked = shuffled_rank(_with_sizes(df, by), seed, ids, [by])
    return ranked.withColumn("fold", tile(F.col("rn"), F.col("n_class").cast("long"), k).cast("long")).drop("rn", "n_class")


def sample_exact(df: DataFrame, n: int, seed: int | str, ids: list[str], within: list[str] | None = None) -> DataFrame:
    """n rows (all, if there are fewer) of each group, without replacement."""
    return shuffled_rank(df, seed, ids, within).where(F.col("rn") <= n).drop("rn")


def balanced(df: DataFrame, seed: int, ids: list[str]) -> DataFrame:
    """All anomalies (y = 1) and as many normals."""
    n = _sizes(df, "y").get(1, 0)
    return df.where("y = 1").unionByName(sample_exact(df.where("y = 0"), n, seed, ids))


def inverted_kfold(df: DataFrame, k: int, normals: int, anomalies: int, seed: int, ids: list[str]) -> DataFrame:
    """(ids, y, fold, role): of a sample of normals, a fold fits on its own part and tests on all others and all
    sampled anomalies."""
    a = sample_exact(df.where("y = 0"), normals, f"{seed}n", ids)
    b = sample_exact(df.where("y = 1"), anomalies, f"{seed}a", ids)
    own = kfold(a, k, seed, ids).withColumnRenamed("fold", "part")
    folds = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold")
    normal = own.select(*ids, "y", "part", folds).withColumn("role", F.when(F.col("part") == F.col("fold"), "fit").otherwise("test"))
    return normal.drop("part").unionByName(b.select(*ids, "y", folds).withColumn("role", F.lit("test")))


def _few(most: int | None) -> Column:
    """The role of anomalies that may validate, by their rank rn: all of them, or the first ``most``."""
    return F.lit("val") if most is None else F.when(F.col("rn") <= most, "val").otherwise("unused")


def stratified(df: DataFrame, k: int, seed: int, ids: list[str], most_val: int | None = None) -> DataFrame:
    """(ids, y, fold, role): a fold's own part of each class is its test; a tenth of the other normals is validation,
    the rest is training; the other anomalies are validation, at most most_val of them if that is given."""
    parts = kfold(df, k, seed, ids).withColumnRenamed("fold", "part")
    each = parts.select(*ids, "y", "part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    test = each.where("part = fold").withColumn("role", F.lit("test"))
    rest = shuffled_rank(each.where("part <> fold"), f"{seed}v", ids, ["fold", "y"])
    sizes = each.where("part <> fold AND y = 0").groupBy("fold").agg(F.count("*").alias("n"))
    rest = rest.join(F.broadcast(sizes), "fold", "left")  # a row for each fold
    role = F.when(F.col("y") == 0, F.when(F.col("rn") <= F.ceil(F.col("n") / 10), "val").otherwise("train")).otherwise(_few(most_val))
    return rest.withColumn("role", role).select(*ids, "y", "fold", "role").unionByName(test.select(*ids, "y", "fold", "role"))


def chronological(df: DataFrame, ids: list[str], time: str, most_val: int | None = None) -> DataFrame:
    """(ids, y, role): the first 70 % of normals in time train, 10 % validate, the rest test; anomalies later than the
    last validation normal test, the earlier ones validate, at most most_val of them if that is given."""
    from logsift.operators.ranks import running_sums

    normal = running_sums(df.where("y = 0"), [F.col(time), *map(F.col, ids)], {"rn": F.lit(1)})
    n = df.where("y = 0").count()
    role = F.when(F.col("rn") <= int(0.7 * n), "train").when(F.col("rn") <= int(0.8 * n), "val").otherwise("test")
    normal = normal.withColumn("role", role)
    last = normal.where("role = 'val'").agg(F.max(time)).first()[0]
    odd = df.where("y = 1").withColumn("late", F.coalesce(F.col(time) > last, F.lit(True)))
    early = odd.where("NOT late")
    early = (early if most_val is None else shuffled_rank(early, "chrono", ids)).withColumn("role", _few(most_val))
    odd = early.select(*ids, "y", "role").unionByName(odd.where("late").withColumn("role", F.lit("test")).select(*ids, "y", "role"))
    return normal.select(*ids, "y", "role").unionByName(odd)
