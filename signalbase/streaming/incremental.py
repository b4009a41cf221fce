"""Drops as a stream: new CSV files become records as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalbase import config
from signalbase.functions import text
from signalbase.operators.records import build_records


def follow(spark: SparkSession, folder: str, spec: config.SourceSpec, headers: Sequence[str], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the records of new UTF-8 files below ``folder`` to Parquet partitions by month.

    Files of one stream share their headers. A batch is written by its number,
    so one that is repeated after a failure replaces itself.
    """
    raw = (
        spark.readStream.schema(", ".join(f"`{h}` string" for h in headers))
        .options(header=True, multiLine=True, quote='"', escape='"', pathGlobFilter="*.csv")
        .csv(folder)
        .withColumn("file_name", F.col("_metadata.file_name"))
    )
    wanted = F.lit(False)
    for pattern in spec.patterns:
        wanted = wanted | F.col("file_name").rlike(pattern)
    rows = raw.filter(wanted).select(
        *(text.pick(list(headers), aliases).alias(c) for c, aliases in (("title", spec.title), ("body", spec.body), ("authors", spec.authors), ("url", spec.url))),
        text.file_date(F.col("file_name")).alias("date"),
        F.concat_ws("/", F.lit(spec.name), "file_name").alias("source"),
        F.lit(spec.kind).alias("intelligence_type"),
    )

    def write(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("ingest_ord", F.lit(number) * F.lit(1 << 40) + F.monotonically_increasing_id())
        records = build_records(placed).withColumn("month", text.month_key(F.col("date")))
        records.write.mode("overwrite").partitionBy("month").parquet(f"{out.rstrip('/')}/batch={number}")

    stream = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream).start()
