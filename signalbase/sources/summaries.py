"""Mergeable summaries of a store's months: facets, counts and the place of a page without the records.

A row counts the records of one date, category, kind and alert flag, and keeps
the first of them in record order. Rows add up over dates and months, so all
that a search shows beside its records, and where a page begins, comes from
them. Their number grows with days and categories, not with records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import text
from signalbase.operators.search import Query, facets_of, page_count, tree_of

SUMMARY = "month string, date string, category string, intelligence_type string, is_alert boolean, n bigint, first struct<date:string,title:string,o:bigint>"


def place() -> Column:
    """A record's place in the record order: of two, the greater comes first."""
    return F.struct("date", "title", (-F.col("ingest_ord")).alias("o"))


def summarise(records: DataFrame) -> DataFrame:
    """``SUMMARY`` of records; a null alert flag is none, a null date empty."""
    keyed = records.select(text.month_key(F.col("date")).alias("month"), F.coalesce("date", F.lit("")).alias("date"), "category", "intelligence_type", F.coalesce("is_alert", F.lit(False)).alias("is_alert"), place().alias("first"))
    return keyed.groupBy("month", "date", "category", "intelligence_type", "is_alert").agg(F.count("*").alias("n"), F.max("first").alias("first"))


def month_kinds(summary: DataFrame, holder: str) -> DataFrame:
    """(month, holder, records, kinds): a store's table of months."""
    kinds = summary.groupBy("month", "intelligence_type").agg(F.sum("n").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("intelligence_type", "n")))
    return kinds.groupBy("month").agg(F.lit(holder).alias("holder"), F.sum("n").alias("records"), F.map_from_entries(pairs).alias("kinds")).select("month", "holder", "records", "kinds")


def category_facets(summary: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """The facets of ``operators.search.category_facets``, from summaries."""
    seen = summary.groupBy(text.blank_to(F.col("category"), config.UNCLASSIFIED).alias("category")).agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    return facets_of(seen, vocabulary)


def category_tree(summary: DataFrame, vocabulary: Sequence[str], needle: str = "", groups: Sequence[str] = config.GROUP_ORDER) -> DataFrame:
    """The tree of ``operators.search.category_tree``, from summaries."""
    return tree_of(category_facets(summary, vocabulary), needle, groups)


def header(summary: DataFrame) -> DataFrame:
    """(total, news, literature, latest) of a store."""
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("intelligence_type") == kind, F.col("n"))), F.lit(0)).alias(kind)
    latest = F.coalesce(F.max(F.when(F.col("date") != "", F.col("date"))), F.lit("")).alias("latest")
    return summary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), of("news"), of("literature"), latest)


def counts(summary: DataFrame, query: Query) -> DataFrame:
    """(shown, total, pages) of a query without a text."""
    if query.needle:
        raise ValueError("summaries do not know texts")
    shown = F.coalesce(F.sum(F.when(query.condition(), F.col("n"))), F.lit(0)).alias("shown")
    return summary.agg(shown, F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("pages", page_count(F.col("shown"), query.page_size))
