"""The month-partitioned store: shards, manifest, snapshot, knowledge, metadata.

Everything is written by Spark below one folder, which may be any URI that
Spark writes. A rewrite goes to a fresh generation; readers take the newest
one that is complete, so a store is never read while it is overwritten and
months that a build no longer has disappear.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalbase import config, schema
from signalbase.functions import text
from signalbase.operators.records import newest_first
from signalbase.operators.search import Query, matches
from signalbase.plans.stats import BuildReport
from signalbase.sources import summaries, text_index
from signalbase.sources.files import delete, exists
from signalbase.sources.shared import staged

#: Rows that a part of the shards holds, at least and at most, about.
PART_ROWS = (4096, 32768)
OPTIONS = {"ignoreNullFields": "false"}
FILES = "source string, name string, bytes bigint, changed bigint"
POINTER = "processed_at string, generation string, form string"
#: A month of a generation: which generation holds its shards (an older one, if the month has not changed since), and its counts.
MONTHS = "month string, holder string, records bigint, kinds map<string,bigint>"


def shard_counts(records: DataFrame) -> DataFrame:
    return records.groupBy(text.month_key(F.col("date")).alias("month")).agg(F.count("*").alias("records"))


def manifest(records: DataFrame) -> DataFrame:
    """(month, path, records), newest month first."""
    path = F.concat(F.lit("processed/month="), F.col("month")).alias("path")
    return shard_counts(records).select("month", path, "records").orderBy(F.desc("month"))


def snapshot_head(records: DataFrame, rows: int = config.SNAPSHOT_ROWS) -> DataFrame:
    return records.orderBy(*newest_first()).limit(rows)


def count_by_type(records: DataFrame) -> DataFrame:
    return records.groupBy("intelligence_type").agg(F.count("*").alias("n"))


def meta_stats(records: DataFrame) -> DataFrame:
    """One row: the total, and counts by type as a map."""
    kinds = count_by_type(records)
    return kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("intelligence_type", "n")))).alias("records_by_type"))


def job_descriptor(meta: DataFrame, target: int = config.TARGET_ROWS, prompt_file: str = "prompts/classification.md") -> DataFrame:
    """The classification job as JSON, from (processed_at, taxonomy_version); the prompt is the caller's."""
    strings = lambda *x: F.array(*map(F.lit, x))
    job = F.struct(
        F.col("processed_at").alias("created_at"),
        "taxonomy_version",
        F.lit(config.JOB_EXTRACTOR).alias("extractor_version"),
        F.lit(target).alias("target_unclassified"),
        F.struct(
            *(F.lit(v).alias(k) for k, v in config.JOB_PHASES.items()),
            strings(*config.JOB_CACHE_KEY).alias("cache_key"),
        ).alias("strategy"),
        F.lit(prompt_file).alias("prompt_file"),
        strings(*config.JOB_RULES).alias("priority_rules"),
        strings(*config.JOB_NOTES).alias("notes"),
    )
    return meta.select(F.to_json(job, {"ignoreNullFields": "false"}).alias("job"))


def manifest_document(months: DataFrame, meta: dict, index: str = "knowledge_index") -> dict:
    """The manifest: the build's meta document, a line for each month, newest first, where the knowledge index is."""
    rows = months.select("month", F.concat(F.lit("processed/month="), F.col("month")).alias("path"), "records", "holder").orderBy(F.desc("month"))
    return {"meta": meta, "shards": [r.asDict() for r in rows.collect()], "knowledge_index": index}


def _listed(rows: DataFrame, order: Sequence[Column], columns: Sequence[str], name: str) -> DataFrame:
    """One row with ``rows``, of which there are few, as an ordered array of structs."""
    place = F.struct(*(c.alias(f"k{k}") for k, c in enumerate(order)), F.struct(*columns).alias("row"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["row"]).alias(name))


def snapshot_document(records: DataFrame, meta: dict, knowledge: DataFrame | None = None) -> DataFrame:
    """One row: the newest records with the meta document and the knowledge documents, as JSON."""
    place = F.row_number().over(Window.orderBy(*newest_first()))
    head = _listed(snapshot_head(records).withColumn("_at", place), [F.col("_at")], records.columns, "records")
    about = F.from_json(F.lit(json.dumps(meta, ensure_ascii=False)), F.schema_of_json(F.lit(json.dumps(meta, ensure_ascii=False))))
    if knowledge is None:
        docs = head.withColumn("knowledge", F.array().cast("array<string>"))
    else:
        listed = _listed(knowledge, [F.col("ord")], [c for c in knowledge.columns if c != "ord"], "knowledge")
        docs = head.withColumn("one", F.lit(1)).join(listed.withColumn("one", F.lit(1)), "one")
    return docs.select(F.to_json(F.struct(about.alias("meta"), "records", "knowledge"), OPTIONS).alias("value"))


def _laid_out(records: DataFrame) -> tuple[DataFrame, int]:
    """(day, first, spread) of each date, newest first: the parts that its records go to; and how many parts there are.

    Only dates are read for it. Ranges of the record order would be sampled,
    for which Spark builds every record a second time.
    """
    spark = records.sparkSession
    days = staged(records.groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n")), "days")
    total = days.agg(F.sum("n")).first()[0] or 0
    rows = min(max(-(-total // int(spark.conf.get("spark.sql.shuffle.partitions"))), PART_ROWS[0]), PART_ROWS[1])
    # One row a date.
    before = F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first, last = F.floor(before / rows), F.floor((before + F.col("n") - 1) / rows)
    return days.select("day", first.alias("first"), (last - first + 1).alias("spread")), max(1, -(-total // rows))


def _write_shards(records: DataFrame, out: str, form: str) -> None:
    days, parts = _laid_out(records)
    month = records.withColumn("month", text.month_key(F.col("date")))
    # Dates in order: a month or date of any size is spread over as many tasks as it needs, and small ones share one.
    at = F.col("first") + F.pmod(F.xxhash64("ingest_ord", "title"), F.col("spread"))
    placed = month.join(F.broadcast(days), F.col("date").eqNullSafe(F.col("day")), "left").withColumn("_at", F.coalesce(at, F.lit(0)).cast("int"))
    spread = placed.repartitionById(parts, F.col("_at")).select(*month.columns).sortWithinPartitions(F.desc("month"), *newest_first())
    writer = spread.write.partitionBy("month")
    (writer.options(**OPTIONS) if form == "json" else writer).format(form).save(f"{out}/processed")


def write_store(records: DataFrame, folder: str, report: BuildReport, knowledge: DataFrame | None = None, form: str = "parquet", keep: int | None = None, months: Collection[str] | None = None, files: DataFrame | None = None) -> str:
    """Write a generation of the store; returns its folder.

    ``records`` may come from the store itself: it is read from an older
    generation. The pointer to the newest is written last. Shards are
    ``parquet``, whose statistics and columns searches can use, or ``json``
    lines. With ``keep``, older generations than that many go, but for months
    that a newer one still holds there.

    With ``months``, ``records`` are those of these months: only their shards are
    written, and all other months stay in the generations that hold them, unread.
    The snapshot then reads the newest months only, as many as fill it.
    """
    if form not in ("json", "parquet"):
        raise ValueError(f"no such form of a store: {form}")
    spark = records.sparkSession
    before = generations(spark, folder) if months is not None else []
    if before and (before[0]["form"] or "json") != form:
        raise ValueError(f"the store's shards are {before[0]['form']}")
    out = f"{folder.rstrip('/')}/generations/{uuid.uuid4().hex}"
    _write_shards(records, out, form)
    written = _read_processed(spark, out, form)
    # One pass over what was written, of which all counts are rolled up.
    summaries.summarise(written).write.parquet(f"{out}/summary")
    table = summaries.month_kinds(spark.read.schema(summaries.SUMMARY).parquet(f"{out}/summary"), out)
    if before:
        table = _months_of(spark, before[0]).filter(~F.col("month").isin(sorted(months))).unionByName(table)
    table.coalesce(1).write.json(f"{out}/months")
    table = spark.read.schema(MONTHS).json(f"{out}/months")
    report.counted({r["k"]: r["n"] for r in table.select(F.explode("kinds").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()})
    meta = report.document()
    dump_json(spark, f"{out}/meta", meta)
    dump_json(spark, f"{out}/manifest", manifest_document(table, meta))
    _write_index(spark, out, form)
    if files is not None:
        files.write.json(f"{out}/files")
    if knowledge is not None:
        knowledge = knowledge.withColumn("updated_at", F.lit(report.at))
        knowledge.write.partitionBy("category").json(f"{out}/knowledge")
        listed = _listed(knowledge, [F.col("ord")], [c for c in knowledge.columns if c != "ord"], "documents")
        listed.select(F.to_json(F.struct(F.lit(report.at).alias("generated_at"), "documents"), OPTIONS).alias("value")).write.text(f"{out}/knowledge_index")
    head, held = [], 0
    for row in table.orderBy(F.desc("month")).collect():
        head.append(row)
        held += row["records"]
        if held >= config.SNAPSHOT_ROWS:
            break
    newest_months = _read_months(spark, head, form).select(*records.columns)
    snapshot_document(newest_months, meta, knowledge).write.text(f"{out}/snapshot")
    pointer = spark.createDataFrame([(report.at, out, form)], POINTER)
    pointer.coalesce(1).write.mode("append").json(f"{folder.rstrip('/')}/pointers")
    if keep:
        prune(spark, folder, keep)
    return out


def _write_index(spark: SparkSession, out: str, form: str) -> None:
    text_index.build_index(_read_processed(spark, out, form)).coalesce(1).write.parquet(f"{out}/text_index")


def generations(spark: SparkSession, folder: str) -> list:
    """The complete generations of a store, newest first; one row each."""
    pointers = f"{folder.rstrip('/')}/pointers"
    if not exists(spark, pointers):
        return []
    return spark.read.schema(POINTER).json(pointers).orderBy(F.desc("processed_at"), F.desc("generation")).collect()


def newest(spark: SparkSession, folder: str) -> str | None:
    """The folder of the newest complete generation."""
    known = generations(spark, folder)
    return known[0]["generation"] if known else None


def prune(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete all complete generations but the newest ``keep`` and those that hold months of them; returns those that went.

    No reader may be on them.
    """
    known = generations(spark, folder)
    kept = {g["generation"] for g in known[: max(1, keep)]}
    for g in known[: max(1, keep)]:
        kept |= {r["holder"] for r in _months_of(spark, g).collect()}
    return [g["generation"] for g in known if g["generation"] not in kept and delete(spark, g["generation"])]


_COLUMNS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.RECORD.fields) + ", ingest_ord bigint, month string"


def _months_of(spark: SparkSession, generation) -> DataFrame:
    path = f"{generation['generation']}/months"
    return spark.read.schema(MONTHS).json(path) if exists(spark, path) else spark.createDataFrame([], MONTHS)


def _reader(spark: SparkSession, generation: str, form: str):
    reader = spark.read.schema(_COLUMNS).option("ignoreCorruptFiles", "true").option("basePath", f"{generation}/processed")
    return reader.option("mode", "PERMISSIVE").format(form or "json")


def _complete(rows: DataFrame) -> DataFrame:
    # A line that is no JSON is a row of nulls, and every record has a hash.
    return rows.filter(F.col("content_hash").isNotNull())


def _read_processed(spark: SparkSession, generation: str, form: str) -> DataFrame:
    return _complete(_reader(spark, generation, form).load(f"{generation}/processed"))


def _read_months(spark: SparkSession, months: Sequence, form: str) -> DataFrame:
    """The records of some rows of ``MONTHS``, a scan for each generation that holds any of them."""
    by_holder: dict[str, list[str]] = {}
    for row in months:
        by_holder.setdefault(row["holder"], []).append(f"{row['holder']}/processed/month={row['month']}")
    parts = [_complete(_reader(spark, holder, form).load(paths)) for holder, paths in sorted(by_holder.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _COLUMNS)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Records with ``month``; a filter on it prunes partitions.

    A store without a generation is empty; unreadable files and lines are passed over.
    """
    known = generations(spark, folder)
    if not known:
        return spark.createDataFrame([], _COLUMNS)
    return _read_months(spark, _months_of(spark, known[0]).orderBy("month").collect(), known[0]["form"])


def month_table(spark: SparkSession, folder: str) -> list:
    """The rows of ``MONTHS`` of the newest generation."""
    known = generations(spark, folder)
    return _months_of(spark, known[0]).orderBy("month").collect() if known else []


def read_months(spark: SparkSession, folder: str, months: Sequence) -> DataFrame:
    """The records of some of ``month_table``'s months; no others are read."""
    return _read_months(spark, months, generations(spark, folder)[0]["form"])


def search_files(spark: SparkSession, folder: str, query: Query, only: Collection[str] | None = None) -> DataFrame:
    """The records of the files that may hold matches of a query: of its months (or those of them in ``only``), and of those the ones that may hold its text."""
    known = generations(spark, folder)
    if not known:
        return spark.createDataFrame([], _COLUMNS)
    form = known[0]["form"]
    months = _months_of(spark, known[0]).filter(query.month_condition()).orderBy("month").collect()
    months = [m for m in months if only is None or m["month"] in only]
    parts = []
    for holder in sorted({m["holder"] for m in months}):
        own = [m for m in months if m["holder"] == holder]
        index = f"{holder}/text_index"
        files = text_index.files_that_may_hold(spark, spark.read.parquet(index), query.needle) if exists(spark, index) else None
        if files is None:
            parts.append(_read_months(spark, own, form))
            continue
        wanted = {f"month={m['month']}" for m in own}
        files = sorted(f for f in files if f.split("/")[-2] in wanted)
        if files:
            parts.append(_complete(_reader(spark, holder, form).load(files)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _COLUMNS)


def search_store(spark: SparkSession, folder: str, query: Query) -> DataFrame:
    """All matches of a query, read from the files that may hold any."""
    return matches(search_files(spark, folder, query), query)


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The summaries of all months of the store; of generations that have none, counted from their shards."""
    known = generations(spark, folder)
    months = _months_of(spark, known[0]).collect() if known else []
    parts = []
    for holder in sorted({m["holder"] for m in months}):
        own = [m for m in months if m["holder"] == holder]
        if exists(spark, f"{holder}/summary"):
            parts.append(spark.read.schema(summaries.SUMMARY).parquet(f"{holder}/summary").filter(F.col("month").isin([m["month"] for m in own])))
        else:
            parts.append(summaries.summarise(_read_months(spark, own, known[0]["form"])))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], summaries.SUMMARY)


def date_counts(spark: SparkSession, folder: str, query: Query) -> list:
    """(month, date, n) of a query's matches, newest first: from summaries, or with a text from the files that may hold it."""
    if query.needle:
        found = search_store(spark, folder, query).groupBy("month", F.coalesce("date", F.lit("")).alias("date")).agg(F.count("*").alias("n"))
    else:
        found = read_summary(spark, folder).filter(query.condition()).groupBy("month", "date").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("date")).collect()


def _span(spark: SparkSession, folder: str, query: Query, days: Sequence) -> DataFrame:
    """A query's matches on some days that follow each other; only their months are read."""
    if not days:
        return spark.createDataFrame([], _COLUMNS)
    found = matches(search_files(spark, folder, query, {d["month"] for d in days}), query)
    date = F.coalesce("date", F.lit(""))
    return found.filter((date <= days[0]["date"]) & (date >= days[-1]["date"]))


def store_page(spark: SparkSession, folder: str, query: Query) -> DataFrame:
    """A page of matches in record order, as ``search`` gives; a page beyond the last gives the last one.

    The counts by date tell on which days the page lies, and only the months of
    these are read: the offset left is below one day's matches.
    """
    counted = date_counts(spark, folder, query)
    pages = max(1, -(-sum(d["n"] for d in counted) // query.page_size))
    start = (min(max(1, query.page), pages) - 1) * query.page_size
    days, before, past = [], 0, 0
    for day in counted:
        if past + day["n"] > start and past < start + query.page_size:
            before = before if days else past
            days.append(day)
        past += day["n"]
    return _span(spark, folder, query, days).orderBy(*newest_first()).offset(start - before).limit(query.page_size)


def page_after(spark: SparkSession, folder: str, query: Query, last: tuple[str, str, int]) -> DataFrame:
    """The page that follows the record at ``last``, its (date, title, ingest_ord): a seek, without an offset.

    Days are taken from that record's on, until those after it fill the page.
    """
    date, title, ordinal = last
    days, held = [], 0
    for day in date_counts(spark, folder, query):
        if day["date"] > date:
            continue
        days.append(day)
        held += day["n"] if day["date"] < date else 0
        if held >= query.page_size:
            break
    own = F.coalesce("date", F.lit(""))
    same = own == date
    beyond = (own < date) | (same & (F.col("title") < title)) | (same & (F.col("title") == title) & (F.col("ingest_ord") > ordinal))
    return _span(spark, folder, query, days).filter(beyond).orderBy(*newest_first()).limit(query.page_size)


def known_files(spark: SparkSession, folder: str) -> set[tuple[str, str, int, int]] | None:
    """(source, name, bytes, time of change) of the drops in the newest generation; None where it does not say."""
    at = newest(spark, folder)
    if at is None or not exists(spark, f"{at}/files"):
        return None
    return {tuple(r) for r in spark.read.schema(FILES).json(f"{at}/files").collect()}


def load_json(spark: SparkSession, path: str, default):
    """A JSON document, or ``default`` where there is none."""
    if not exists(spark, path):
        return default
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def dump_json(spark: SparkSession, path: str, payload, indent: int | None = None) -> None:
    """A small JSON document, written unescaped as UTF-8."""
    body = json.dumps(payload, ensure_ascii=False, indent=indent, separators=None if indent else (",", ":"))
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_taxonomy(spark: SparkSession, path: str) -> tuple[str, list[config.Leaf]]:
    """Version and leaves of a taxonomy file; without one, ``unknown`` and none."""
    if not exists(spark, path):
        return "unknown", []
    row = spark.read.schema(schema.TAXONOMY).json(path, multiLine=True).first()
    return row["version"] or "unknown", [config.Leaf(tuple(x["path"] or ()), tuple(x["keywords"] or ()), x["label"]) for x in row["leaves"] or []]


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """The ordered categories of a vocabulary file; without one, none."""
    if not exists(spark, path):
        return []
    row = spark.read.schema("categories array<string>").json(path, multiLine=True).first()
    return list(row["categories"] or [])
