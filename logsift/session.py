"""Session defaults, and tables that cut a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that a task sorts, about, where a table is dealt by in_parts().
PART_ROWS = 500_000

#: Whether an execution's shuffle files go when it ends. Else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configured(spark: SparkSession) -> SparkSession:
    """UTC, so that integer time buckets do not depend on where the session runs."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and Spark runs on this machine alone (as in tests) a
    folder of our own is made and set. A cluster must name a folder that all its machines share."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: it survives lost executors and is computed once; what was
    shuffled for it is removed. The result's table_rows is how many rows it has, counted as they were written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    written, before = Observation(), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path, out.table_rows = path, written.get["rows"]
    return out


def in_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys into parts of about PART_ROWS of its ``rows``, so that what a task sorts or counts does not grow with the
    table; one that the cores share in smaller parts anyway is left as it is."""
    n = -(-rows // PART_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() returned; nothing that is still to be computed may read them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
