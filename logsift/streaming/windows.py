"""Window operators over streams; each gives what its batch form gives for rows that are not too late."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import configured, shared_dir


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (a file or a folder of files) as a stream of its files."""
    schema = spark.read.parquet(path).schema
    one = f"{path[:-1]}[{path[-1]}]"  # as a pattern, which a stream takes for a single file too
    return configured(spark).readStream.schema(schema).parquet(one)


def with_time(stream: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with a watermark; rows later than it are dropped."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(stream: DataFrame, window: Column, keys: list[str], aggs: list[Column]) -> DataFrame:
    return stream.groupBy(*keys, window.alias("w")).agg(*aggs)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream of rows over all that is there, appending to Parquet."""
    at = f"{shared_dir(stream.sparkSession)}/stream-{name}-{uuid.uuid4().hex}"
    return _append(stream, at)


def drain_windows(spark: SparkSession, path: str, late: str, name: str, windows: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """Windows of a table's stream of events, each written once, when the watermark has passed its end, and then forgotten:
    state holds open windows only. At the end a row of a second source, a year after the last event, lets the watermark
    pass the windows that are still open; its own window is never written."""
    at = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    batch = spark.read.parquet(path)
    batch.limit(0).write.parquet(f"{at}/end")
    events = stream_table(spark, path).unionByName(spark.readStream.schema(batch.schema).parquet(f"{at}/end"))
    held = windows(with_time(events, late, ts))
    _append(held, at)
    end = F.max(F.col(ts).cast("timestamp")) + F.expr("INTERVAL 365 DAYS")
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in batch.schema.fields if f.name != ts]
    batch.agg(end.cast(batch.schema[ts].dataType).alias(ts)).select(ts, *others).write.mode("append").parquet(f"{at}/end")
    return _append(held, at)


def _append(stream: DataFrame, at: str) -> DataFrame:
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")
