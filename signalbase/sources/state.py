"""What earlier builds have classified: one row a content hash, bucketed, kept up to date by merges.

A build joins its records with this table instead of reading whole earlier shards.
The table's files are bucketed by hash, so neither the join nor a merge shuffles
it; only new rows travel, to the buckets they belong to. Each merge writes a new
version beside the last one, so a reader never sees one half written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import text
from signalbase.operators.records import carry_eligible, overlay
from signalbase.sources import store
from signalbase.sources.files import exists

#: Buckets of a new state. At 10^10 hashes of some 100 bytes each a bucket of 512 holds 2 GB.
BUCKETS = 64
STATE = "content_hash string, month string, ingest_ord bigint, category string, classification_confidence double, classification_reason string, classifier_model string, classifier_provider string"
_POINTER = "at bigint, version string, buckets int, covered array<struct<month:string,holder:string>>"


def latest(records: DataFrame, models: Sequence[str] = config.TRUSTED_MODELS) -> DataFrame:
    """The state of some records: of each hash the eligible row of the latest month, then of the highest place."""
    rows = carry_eligible(records, models).withColumn("month", text.month_key(F.col("date")))
    columns = [c.split()[0] for c in STATE.split(", ")]
    best = F.max_by(F.struct(*columns[1:]), F.struct("month", "ingest_ord"))
    return rows.groupBy("content_hash").agg(best.alias("kept")).select("content_hash", "kept.*")


def _versions(spark: SparkSession, folder: str) -> list:
    pointers = f"{folder.rstrip('/')}/state/pointers"
    return spark.read.schema(_POINTER).json(pointers).orderBy(F.desc("at")).collect() if exists(spark, pointers) else []


def _attach(spark: SparkSession, version: str, buckets: int) -> DataFrame:
    """A version's files as a bucketed table of this session's catalogue."""
    name = "signalbase_state_" + version.rstrip("/").split("/")[-1]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({STATE}) USING parquet CLUSTERED BY (content_hash) INTO {int(buckets)} BUCKETS LOCATION '{version}'")
    return spark.table(name)


def read_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest version; None where there is none."""
    known = _versions(spark, folder)
    return _attach(spark, known[0]["version"], known[0]["buckets"]) if known else None


def write_state(state: DataFrame, folder: str, buckets: int = BUCKETS, covered: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """A new version of the state, one file a bucket; returns it as read. ``covered`` are the (month, holder) whose records are in it."""
    spark = state.sparkSession
    name = uuid.uuid4().hex
    version = f"{folder.rstrip('/')}/state/{name}"
    laid = state.select(*(c.split()[0] for c in STATE.split(", "))).repartition(buckets, "content_hash")
    laid.write.bucketBy(buckets, "content_hash").option("path", version).format("parquet").saveAsTable(f"signalbase_state_{name}")
    known = _versions(spark, folder)
    pointer = spark.createDataFrame([((known[0]["at"] if known else 0) + 1, version, buckets, list(covered))], _POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{folder.rstrip('/')}/state/pointers")
    return _attach(spark, version, buckets)


def merged(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Both states' rows, of equal hashes the one of the later month, then the higher place, then the fresh one.

    A classification outlives the record it was made for: text that comes back
    later is known again.
    """
    columns = [c for c in fresh.columns if c != "content_hash"]
    a, b = F.struct(*(old[c] for c in columns)), F.struct(*(fresh[c] for c in columns))
    later = old["content_hash"].isNull() | (fresh["content_hash"].isNotNull() & (F.struct(fresh["month"], fresh["ingest_ord"]) >= F.struct(old["month"], old["ingest_ord"])))
    both = old.join(fresh, old["content_hash"] == fresh["content_hash"], "full_outer")
    return both.select(F.coalesce(old["content_hash"], fresh["content_hash"]).alias("content_hash"), F.when(later, b).otherwise(a).alias("kept")).select("content_hash", "kept.*")


def refresh_state(spark: SparkSession, folder: str, models: Sequence[str] = config.TRUSTED_MODELS) -> DataFrame | None:
    """The state of the store at ``folder``; only months written since its last version are read and merged in."""
    known, months = _versions(spark, folder), store.month_table(spark, folder)
    seen = {(c["month"], c["holder"]) for c in known[0]["covered"]} if known else set()
    todo = [m for m in months if (m["month"], m["holder"]) not in seen]
    if not todo:
        return read_state(spark, folder)
    fresh = latest(store.read_months(spark, folder, todo), models)
    now = [(m["month"], m["holder"]) for m in months]
    if not known:
        return write_state(fresh, folder, covered=now)
    return write_state(merged(read_state(spark, folder), fresh), folder, known[0]["buckets"], now)


def carry_from_state(records: DataFrame, state: DataFrame | None) -> DataFrame:
    """``records`` with the classifications that the state knows for their texts."""
    return records if state is None else overlay(records, state)
