"""Knowledge per category: counts, units, values, evidence, and whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import text
from signalbase.operators.records import newest_first


def _grouped(records: DataFrame) -> DataFrame:
    return records.withColumn("category", text.blank_to(F.col("category"), config.UNCLASSIFIED))


def category_universe(records: DataFrame, leaves: Sequence[config.Leaf]) -> DataFrame:
    """(category, ord): the taxonomy's categories in their order, then the other observed ones by code point."""
    spark = records.sparkSession
    known = spark.createDataFrame([(leaf.name, k) for k, leaf in enumerate(leaves)], "category string, leaf_ord long")
    seen = _grouped(records).select("category", F.lit(None).cast("long").alias("leaf_ord")).distinct()
    every = known.unionByName(seen).groupBy("category").agg(F.min("leaf_ord").alias("leaf_ord"))
    # One row for each category: their order is one small window.
    order = Window.orderBy(F.asc_nulls_last("leaf_ord"), F.asc("category"))
    return every.select("category", (F.row_number().over(order) - 1).cast("long").alias("ord"))


def unknown_categories(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """Observed categories that ``names`` lacks."""
    known = records.sparkSession.createDataFrame([(n,) for n in names], "category string")
    return _grouped(records).select("category").distinct().join(known, "category", "left_anti")


def knowledge_counts(records: DataFrame, leaves: Sequence[config.Leaf]) -> DataFrame:
    """(category, ord, n, news, literature), with zeros for categories without records."""
    kind = F.col("intelligence_type")
    counted = _grouped(records).groupBy("category").agg(F.count("*").alias("n"), F.count_if(kind == "news").alias("news"), F.count_if(kind == "literature").alias("literature"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return category_universe(records, leaves).join(counted, "category", "left").select("category", "ord", zero("n"), zero("news"), zero("literature"))


def knowledge_profile(counts: DataFrame) -> DataFrame:
    return counts.select("category", F.format_string(config.PROFILE, "n", "news", "literature").alias("basic_profile"))


def _params(records: DataFrame) -> DataFrame:
    """A row for each parameter, with a sortable key of its record."""
    rows = _grouped(records).select("category", "date", "title", "ingest_ord", F.posexplode("key_parameters").alias("pos", "param"))
    return rows


def key_metrics(records: DataFrame, most: int = config.KEY_METRICS) -> DataFrame:
    """(category, unit, n, rank): a category's most frequent units; of equal ones the first to appear."""
    unit = text.blank_to(F.col("param.unit"), config.NO_UNIT)
    first = F.max(F.struct("date", "title", (-F.col("ingest_ord")).alias("o"), (-F.col("pos")).alias("p"))).alias("first")
    counted = _params(records).groupBy("category", unit.alias("unit")).agg(F.count("*").alias("n"), first)
    # Units of a category, already counted: few rows a window.
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), F.desc("first")))
    return counted.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).drop("first")


def _first_per_category(rows: DataFrame, order: tuple, most: int) -> DataFrame:
    """The first rows of each category. Spark keeps ``most`` a task before it shuffles, so no category meets whole."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*order))
    return rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)


def frontier_values(records: DataFrame, most: int = config.FRONTIER_VALUES) -> DataFrame:
    """(category, rank, param...): the first parameters of each category, which lie in as many of its first records that have any."""
    some = _grouped(records).filter(F.size("key_parameters") > 0).select("category", "date", "title", "ingest_ord", "key_parameters")
    held = _first_per_category(some, newest_first(), most).drop("rank")
    rows = _first_per_category(_params(held), (*newest_first(), F.asc("pos")), most)
    return rows.select("category", "rank", "ingest_ord", "pos", "param.*")


def evidence(records: DataFrame, most: int = config.EVIDENCE_ROWS) -> DataFrame:
    """The first records of each category, with the first parameters of each."""
    rows = _grouped(records).select("category", "title", "url", "date", "intelligence_type", "ingest_ord", F.slice("key_parameters", 1, config.EVIDENCE_PARAMS).alias("key_parameters"))
    return _first_per_category(rows, newest_first(), most)


def knowledge_docs(records: DataFrame, leaves: Sequence[config.Leaf]) -> DataFrame:
    """A nested document for each category, in order of ``ord``.

    Only the bounded lists (units, values, evidence) are collected per category.
    """
    listed = lambda rows, *fields: rows.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("v")))).alias("l")).select("category", F.transform("l", lambda x: x["v"]).alias("l"))
    units = listed(key_metrics(records), "unit", F.col("n").alias("count")).withColumnRenamed("l", "key_metrics")
    params = ("value_raw", "value_numeric", "unit", "evidence_text", "extraction_reason", "confidence")
    values = listed(frontier_values(records), *params).withColumnRenamed("l", "frontier_values")
    shown = listed(evidence(records), "title", "url", "date", "intelligence_type", "key_parameters").withColumnRenamed("l", "evidence")
    counts = knowledge_counts(records, leaves)
    profile = F.format_string(config.PROFILE, "n", "news", "literature").alias("basic_profile")
    docs = counts.select("category", "ord", profile).join(units, "category", "left").join(values, "category", "left").join(shown, "category", "left")
    filled = docs.select(*(F.coalesce(c, F.array().cast(docs.schema[c].dataType)).alias(c) if c in ("key_metrics", "frontier_values", "evidence") else F.col(c) for c in docs.columns))
    summary = F.struct("basic_profile", F.array(F.lit(config.BOTTLENECK)).alias("bottlenecks"), "key_metrics", "frontier_values")
    return filled.select("ord", "category", summary.alias("summary"), "evidence")
