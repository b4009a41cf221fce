"""Row numbers within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbase.sources.shared import staged


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "idx") -> DataFrame:
    """``df`` with each row's number in its group, from 0, by a total order.

    No group meets in one task: rows are range-partitioned by group and order,
    numbered where they lie, and moved up by the rows that earlier partitions
    hold of the group, of which there is one count for each partition.
    """
    keys = [F.asc_nulls_first(g) for g in group]
    laid = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    laid = staged(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    counts = laid.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")
    offsets = counts.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return laid.join(offsets, same).select(*df.columns, number.alias(name))
