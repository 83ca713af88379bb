"""Streams against batches, and late rows."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from logsift.streaming import windows


def test_late_rows_are_dropped_and_on_time_rows_are_not(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, node int"
    spark.createDataFrame([(at(1), 1), (at(2), 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = windows.with_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "10 minutes")
    out, state = f"{folder}-out", f"{folder}-state"

    def run():
        held = windows.windowed(stream, F.window("ts", "1 hour"), ["node"], [F.count("*").alias("n")])
        held.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(at(9), 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    spark.createDataFrame([(at(1, 30), 1), (at(12), 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    spark.createDataFrame([(at(20), 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    found = {r["w"]["start"].hour: r["n"] for r in spark.read.parquet(out).collect()}
    assert found[1] == 1 and found[2] == 1 and found[9] == 1 and found[12] == 1


def test_fixed_counts_of_a_stream_are_those_of_the_batch(spark):
    """Lines out of order within the watermark, over several batches and a restart; gaps close windows that are not full."""
    import random

    from logsift.operators import sequences
    from logsift.streaming import stateful

    rng, folder, schema = random.Random(1), tempfile.mkdtemp(prefix="spark-"), "ts timestamp, node string, id long, y int"
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=20 * i), rng.choice(["a", "b", "b", None]), i, int(rng.random() < 0.1)) for i in range(300)]
    moved = [r for _, r in sorted((i + rng.randint(0, 20), r) for i, r in enumerate(rows))]  # at most seven minutes late
    stream = windows.with_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "10 minutes")

    def run(parts):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        q = stateful.fixed_count(stream, 7, "node", "2 days").writeStream.format("parquet").option("path", f"{folder}-out")
        q.option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(str, spark.read.parquet(f"{folder}-out").collect()))

    early = run([moved[:90], moved[90:150]])
    late = [(start + dt.timedelta(days=d), "a", 1000 + d, 1) for d in (4, 9)]
    found = run([moved[150:], late[:1], late[1:], [(None, "a", 1, 1)]])
    batch = sequences.fixed_count(spark.createDataFrame(rows, schema), 7, ["node"], ["ts", "id"]).groupBy("node", "window_no").agg(F.count("*").alias("n"), F.max("y").alias("y"))
    want = {(r["node"], r["window_no"], r["n"], r["y"]) for r in batch.collect()} | {("a", 0, 1, 1)}  # the line of day 4 alone, after a gap
    assert set(early) <= set(found) and len(found) == len(want)
    assert {(r["node"], r["window_no"], r["n"], r["y"]) for r in spark.read.parquet(f"{folder}-out").collect()} == want
