"""What writing a table leaves behind."""

import os
import time

from pyspark.sql import functions as F

from logsift import session


def shuffled(spark):
    top = spark.sparkContext.getConf().get("spark.local.dir")
    return {f"{d}/{f}" for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    table = session.materialize(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:  # executors remove them a little later
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert table.table_rows == 100 and table.agg(F.sum("n")).first()[0] == 5000


def test_the_setting_is_as_it_was(spark):
    found = spark.conf.get(session.CLEANUP)
    session.materialize(spark.range(3))
    assert spark.conf.get(session.CLEANUP) == found
