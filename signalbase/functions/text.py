"""Scalar expressions over text fields; all are built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbase import config

#: White space by Unicode, with the separators U+001C to U+001F and U+0085.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def blank_to(value: Column, default: str) -> Column:
    """``value``, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def clean(value: Column) -> Column:
    """White space collapsed to single spaces and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), f"{WHITE}+", " "))


def pick(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """The first alias that is not blank: by its exact header, else by one that equals it but for case."""
    folded = {c.lower(): c for c in columns}
    tried = []
    for alias in aliases:
        tried += [c for c in (alias if alias in columns else None, folded.get(alias.lower())) if c]
    values = [F.nullif(clean(F.col(f"`{c}`")), F.lit("")) for c in dict.fromkeys(tried)]
    return F.coalesce(*values, F.lit(""))


def content_hash(title: Column, body: Column, authors: Column, url: Column) -> Column:
    """SHA-256 of the four fields joined by spaces; empty fields keep their space."""
    return F.sha2(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (title, body, authors, url))), 256)


def file_date(name: Column) -> Column:
    """The first ISO date in a file name, else ``unknown``."""
    return blank_to(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), "unknown")


def month_of_name(name: str) -> str:
    """The month key that the records of a file of this name have."""
    found = re.search(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", name)
    return found[0][:7] if found else "unknown"


def month_key(date: Column) -> Column:
    return F.substring(blank_to(date, "unknown"), 1, 7)


def normalize_category(path: Column) -> Column:
    """Slashes to dashes; full-width parentheses dropped."""
    return F.translate(path, "/（）", "-")


def normalize_category_ui(path: Column) -> Column:
    """As ``normalize_category``; ASCII parentheses dropped too, null becomes empty."""
    return F.translate(F.coalesce(path, F.lit("")), "/（）()", "-")


def category_full(category: Column) -> Column:
    return F.translate(category, "-", "/")


def category_top(category: Column) -> Column:
    return F.split_part(category_full(category), F.lit("/"), F.lit(1))


def short_label(category: Column) -> Column:
    """The path without its first segment, joined by spaced slashes; the whole of a path of one segment."""
    full = category_full(category)
    rest = F.array_join(F.slice(F.split(full, "/"), 2, 1000), " / ")
    return F.coalesce(F.nullif(rest, F.lit("")), full)


def category_display(category: Column) -> Column:
    return F.replace(blank_to(category, config.UNCLASSIFIED), F.lit("-"), F.lit(" / "))


def html_escape(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def preview(body: Column, chars: int = config.SUMMARY_CHARS, default: str = config.NO_BODY) -> Column:
    """The first ``chars`` code points, or ``default`` where there are none."""
    return blank_to(F.substring(body, 1, chars), default)


def type_label(kind: Column) -> Column:
    return F.when(kind == "literature", config.LITERATURE_LABEL).otherwise(config.NEWS_LABEL)
