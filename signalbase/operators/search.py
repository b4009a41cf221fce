"""Faceted search: filters, paging, cards, category tree."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import text
from signalbase.operators.records import newest_first

SEARCHED = ("title", "body", "category", "source", "url", "authors")


def haystack() -> Column:
    """What a text search looks into, in lower case."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in SEARCHED)))


@dataclass(frozen=True)
class Query:
    """What a search asks for; inactive parts are empty or ``all``."""

    text: str = ""
    date_from: str = ""
    date_to: str = ""
    category: str = ""
    kind: str = "all"
    alert: str = "all"
    page: int = 1
    page_size: int = config.PAGE_SIZE

    @property
    def needle(self) -> str:
        return self.text.strip().lower()

    def condition(self) -> Column:
        """All active parts, cheap ones first.

        A date range also bounds the month, by which stores are partitioned.
        """
        parts = []
        if self.date_from:
            parts.append((F.col("date") != "") & (F.col("date") >= self.date_from))
        if self.date_to:
            parts.append((F.col("date") != "") & (F.col("date") <= self.date_to))
        if self.category:
            parts.append(F.col("category") == self.category)
        if self.kind != "all":
            parts.append(F.col("intelligence_type") == self.kind)
        if self.alert in ("yes", "no"):
            flag = F.coalesce(F.col("is_alert"), F.lit(False))
            parts.append(flag if self.alert == "yes" else ~flag)
        needle = self.needle
        if needle:
            parts.append(F.contains(haystack(), F.lit(needle)))
        out = F.lit(True)
        for part in parts:
            out = out & part
        return out

    def month_condition(self) -> Column:
        """The range of months that the range of dates spans."""
        out = F.lit(True)
        if self.date_from:
            out = out & (F.col("month") >= self.date_from[:7])
        if self.date_to:
            out = out & (F.col("month") <= self.date_to[:7])
        return out

    def cleared(self, key: str) -> Query:
        """Without one of its parts, on the first page again."""
        parts = {"query": {"text": ""}, "date": {"date_from": "", "date_to": ""}, "category": {"category": ""}, "type": {"kind": "all"}, "alert": {"alert": "all"}}
        return replace(self, page=1, **parts[key])

    def toggled(self, category: str) -> Query:
        """With a category chosen, or left again if it was."""
        return replace(self, page=1, category="" if self.category == category else category)

    def quick(self, span: str, as_of: dt.date) -> Query:
        """Dates of today, of the last 7 or 30 days, or all."""
        if span == "all":
            return replace(self, page=1, date_from="", date_to="")
        back = {"today": 0, "7d": 6, "30d": 29}[span]
        return replace(self, page=1, date_from=(as_of - dt.timedelta(days=back)).isoformat(), date_to=as_of.isoformat())

    def describe(self) -> list[tuple[str, str, str]]:
        """(key, label, value) of each active part."""
        out = {}
        if self.text.strip():
            out["query"] = self.text.strip()
        if self.date_from or self.date_to:
            same = self.date_from == self.date_to
            out["date"] = self.date_from if same else f"{self.date_from or '…'} ~ {self.date_to or '…'}"
        if self.category:
            out["category"] = self.category.replace("-", " / ")
        if self.kind != "all":
            out["type"] = config.NEWS_LABEL if self.kind == "news" else config.LITERATURE_LABEL
        if self.alert != "all":
            out["alert"] = config.ALERT_LABELS["yes" if self.alert == "yes" else "no"]
        return [(k, config.CHIP_LABELS[k], v) for k, v in out.items()]


def matches(records: DataFrame, query: Query) -> DataFrame:
    out = records.filter(query.condition())
    return out.filter(query.month_condition()) if "month" in records.columns else out


def page_count(n: Column, size: int = config.PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / size)).cast("long")


def search(records: DataFrame, query: Query) -> DataFrame:
    """A page of matches in record order; a page beyond the last gives the last one."""
    found = matches(records, query)
    page = max(1, query.page)
    if page > 1:
        pages = found.agg(page_count(F.count("*"), query.page_size).alias("n")).first()["n"]
        page = min(page, pages)
    # A page is a top-k with an offset: nothing is sorted as a whole.
    return found.orderBy(*newest_first()).offset((page - 1) * query.page_size).limit(query.page_size)


def counts(records: DataFrame, query: Query) -> DataFrame:
    """(shown, total, pages) in one pass."""
    return records.agg(F.count_if(query.condition()).alias("shown"), F.count("*").alias("total")).withColumn("pages", page_count(F.col("shown"), query.page_size))


def record_cards(records: DataFrame) -> DataFrame:
    """What a result list shows of each record."""
    return records.select(
        "ingest_ord",
        text.html_escape(text.blank_to(F.col("date"), config.NO_DATE)).alias("date_label"),
        text.type_label(F.col("intelligence_type")).alias("type_label"),
        F.coalesce("is_alert", F.lit(False)).alias("is_alert"),
        text.html_escape(text.blank_to(F.col("title"), config.NO_TITLE)).alias("title_html"),
        text.html_escape(F.col("url")).alias("url_html"),
        text.html_escape(text.preview(F.col("body"))).alias("summary_html"),
        text.html_escape(text.category_display(F.col("category"))).alias("category_html"),
        (F.coalesce("category", F.lit("")) == config.UNRELATED).alias("is_unrelated"),
    )


def latest_date(records: DataFrame) -> DataFrame:
    return records.filter(F.col("date") != "").agg(F.coalesce(F.max("date"), F.lit("")).alias("latest"))


def header_counts(records: DataFrame, total: int = 0, news: int = 0, literature: int = 0) -> DataFrame:
    """The stated totals, recounted where they are missing or 0."""
    of = lambda given, counted: (F.lit(given).cast("long") if given else counted)
    kind = F.col("intelligence_type")
    return records.agg(of(total, F.count("*")).alias("total"), of(news, F.count_if(kind == "news")).alias("news"), of(literature, F.count_if(kind == "literature")).alias("literature"))


def category_facets(records: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(category, n, ord): each category of the vocabulary in its order, then the others in the order of their first record.

    A category that the vocabulary lists twice comes twice.
    """
    seen = records.groupBy(text.blank_to(F.col("category"), config.UNCLASSIFIED).alias("category")).agg(F.count("*").alias("n"), F.max(F.struct("date", "title", (-F.col("ingest_ord")).alias("o"))).alias("first"))
    return facets_of(seen, vocabulary)


def facets_of(seen: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """The facets of categories counted already, as (category, n, first)."""
    spark = seen.sparkSession
    listed = spark.createDataFrame(list(enumerate(vocabulary)), "vocab_ord long, path string").select("vocab_ord", text.normalize_category_ui(F.col("path")).alias("category"))
    both = seen.join(listed, "category", "full_outer")
    return both.select("category", F.coalesce("n", F.lit(0)).alias("n"), "vocab_ord", "first")


def facet_order() -> tuple[Column, ...]:
    return F.asc_nulls_last("vocab_ord"), F.desc("first")


def category_tree(records: DataFrame, vocabulary: Sequence[str], needle: str = "", groups: Sequence[str] = config.GROUP_ORDER) -> DataFrame:
    """A row for each category that the needle shows, with its group's rank and total."""
    return tree_of(category_facets(records, vocabulary), needle, groups)


def tree_of(facets: DataFrame, needle: str = "", groups: Sequence[str] = config.GROUP_ORDER) -> DataFrame:
    """The tree of facets counted already."""
    q = needle.strip().lower()
    if q:
        facets = facets.filter(F.contains(F.lower("category"), F.lit(q)) | F.contains(F.lower(text.category_full(F.col("category"))), F.lit(q)))
    named = facets.withColumns({"top": text.category_top(F.col("category")), "label": text.short_label(F.col("category"))})
    place = F.array_position(F.array(*map(F.lit, groups)), F.col("top"))
    # The tree has a row for each category: its groups are small windows.
    return named.select(
        "top",
        "category",
        "label",
        "n",
        F.sum("n").over(Window.partitionBy("top")).alias("group_total"),
        F.when(place > 0, place - 1).otherwise(99).cast("long").alias("group_rank"),
        "vocab_ord",
        "first",
    )
