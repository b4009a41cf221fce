import os

from pyspark.sql import functions as F

from signalbase.sources import shared


def shuffle_files(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    return {f for folder in folders for _, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}


def test_the_shuffles_of_a_staged_table_leave_the_disk(spark):
    before, setting = shuffle_files(spark), spark.conf.get(shared.CLEANUP)
    rows = spark.range(100_000).groupBy((F.col("id") % 70_000).alias("k")).agg(F.sum("id").alias("x"))
    made = shared.staged(rows, "test-shuffles")
    assert not shuffle_files(spark) - before
    assert made.count() == 70_000 and spark.conf.get(shared.CLEANUP) == setting
    # The frame itself can be run again.
    assert shared.staged(rows, "test-shuffles").count() == rows.count() == 70_000
