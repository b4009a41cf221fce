"""Daily CSV drops: discovery, encodings, and one row schema.

A folder of drops is a directory below a root; the root is a local or mounted
path or any URI that Spark reads. Files are decoded as UTF-8 (with or without
a byte order mark), else as GB18030; a file in neither gives no rows.

Files in UTF-8 are read by Spark's CSV reader, a scan for each header among
them, so that a column's aliases are settled before anything is read and no
file is held whole. A pass over the lines tells which files those are. What the
two readers would take apart differently goes the other way, through Python:
GB18030, single carriage returns as line ends, quotes that neither begin nor
end a cell, and headers that are blank or run over several lines.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Collection, Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import text
from signalbase.operators.records import union_sources
from signalbase.plans.stats import BuildReport
from signalbase.sources.files import listing

RAW = "file_name string, row long, cells map<string,string>"


def drop_files(spark: SparkSession, root: str, spec: config.SourceSpec, report: BuildReport | None = None) -> list[tuple[str, str, int, int]]:
    """(path, name, bytes, time of change) of a source's files in order of name; none, and a warning, where its folder is missing."""
    folder = f"{root.rstrip('/')}/{spec.subdir}"
    found = listing(spark, folder)
    if found is None and report is not None:
        report.warnings.append(f"missing folder: {folder}")
    files = [f for f in found or [] if f[1].endswith(".csv") and any(re.match(p, f[1]) for p in spec.patterns)]
    if report is not None:
        report.saw_files(spec.name, len(files))
    return files


def profile(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...] | None]:
    """Each file's header by its name, where Spark's reader takes the file apart as Python's does; else None. Empty files are left out.

    A split scan of lines, of which a row a file is kept.
    """
    lines = spark.read.text(list(paths), lineSep="\n")
    line = F.when(F.is_valid_utf8("value"), F.col("value"))
    # Doubled quotes aside, a quote opens a cell or closes one.
    loose = F.regexp_like(F.replace(line, F.lit('""'), F.lit("")), F.lit(r'[^,\x{FEFF}]"[^,\r]')) | F.contains(line, F.lit("\0"))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    kept = lines.select(F.col("_metadata.file_name").alias("name"), line.alias("line"), (line.isNull() | loose | F.regexp_like(line, F.lit(r"\r[\s\S]"))).alias("odd"), place.alias("at"))
    out = {}
    for row in kept.groupBy("name").agg(F.bool_or("odd").alias("odd"), F.min_by("line", "at").alias("head")).collect():
        head = (row["head"] or "").removeprefix("\ufeff").rstrip("\r")
        plain = not row["odd"] and head and head.count('"') % 2 == 0
        out[unquote(row["name"])] = tuple(next(csv.reader([head]))) if plain else None
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """CSV records of whole files; a drop is a day's file, so one task holds a few of them."""
    import io
    import sys

    csv.field_size_limit(sys.maxsize)
    for batch in batches:
        for name, content in zip(batch["file_name"], batch["content"]):
            for encoding in ("utf-8-sig", "gb18030"):
                try:
                    decoded = content.decode(encoding)
                    break
                except UnicodeDecodeError:
                    decoded = ""
            # Cells beyond the header are dropped; missing ones are null.
            rows = ({k: v for k, v in row.items() if k is not None} for row in csv.DictReader(io.StringIO(decoded, newline="")))
            part, at = [], 0
            for row in rows:
                part.append(row)
                if len(part) == 1000:
                    yield pd.DataFrame({"file_name": name, "row": range(at, at + len(part)), "cells": part})
                    part, at = [], at + len(part)
            if part:
                yield pd.DataFrame({"file_name": name, "row": range(at, at + len(part)), "cells": part})


def _record(rows: DataFrame, spec: config.SourceSpec, cells: Callable[[str], list[Column]]) -> DataFrame:
    """A source's rows from (file_name, row, ...); ``cells`` are the columns that an alias may mean, best first."""

    def first(aliases: Sequence[str]) -> Column:
        tried = [c for a in aliases for c in cells(a)]
        return F.coalesce(*(F.nullif(text.clean(c), F.lit("")) for c in tried), F.lit(""))

    return rows.select(
        first(spec.title).alias("title"),
        first(spec.body).alias("body"),
        first(spec.authors).alias("authors"),
        first(spec.url).alias("url"),
        text.file_date(F.col("file_name")).alias("date"),
        F.concat_ws("/", F.lit(spec.name), "file_name").alias("source"),
        F.lit(spec.kind).alias("intelligence_type"),
        "file_name",
        "row",
    )


def _native(spark: SparkSession, paths: Sequence[str], header: tuple[str, ...], spec: config.SourceSpec) -> DataFrame:
    """The rows of UTF-8 files of one header."""
    schema = ", ".join(f"c{k} string" for k in range(len(header)))
    # A cell may run over lines, so a file is one task's, which streams it.
    rows = spark.read.schema(schema).csv(list(paths), header=True, multiLine=True, escape='"', mode="PERMISSIVE", encoding="UTF-8")
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("file_name")
    # Within a file this counts up with its records; the upper bits number tasks.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
    last = {cell: k for k, cell in enumerate(header)}

    def cells(alias: str) -> list[Column]:
        alike = [cell for cell in dict.fromkeys(header) if cell.lower() == alias.lower()]
        return [F.col(f"c{last[cell]}") for cell in ([alias] if alias in last else []) + alike[-1:]]

    return _record(rows.select("*", name, place), spec, cells)


def _decoded(spark: SparkSession, paths: Sequence[str], spec: config.SourceSpec) -> DataFrame:
    """The rows of files that Python takes apart."""
    if paths:
        files = spark.read.format("binaryFile").load(list(paths))
        raw = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").mapInPandas(_rows, RAW)
    else:
        raw = spark.createDataFrame([], RAW)
    # Headers differ from file to file: aliases are looked up in each row's own cells.
    return _record(raw, spec, lambda alias: [F.element_at("cells", F.lit(alias)), _any_case(alias)])


def _any_case(alias: str) -> Column:
    """The cell whose header equals ``alias`` but for case, the last of several."""
    alike = F.map_values(F.map_filter("cells", lambda k, v: F.lower(k) == F.lit(alias.lower())))
    return F.get(alike, F.size(alike) - 1)


def read_source(spark: SparkSession, root: str, spec: config.SourceSpec, report: BuildReport | None = None, months: Collection[str] | None = None) -> DataFrame:
    """(title, body, authors, url, date, source, intelligence_type, file_name, row) of one source, of some months only if asked.

    ``row`` counts up with a file's records, not always by one.
    """
    files = {name: path for path, name, _, _ in drop_files(spark, root, spec, report) if months is None or text.month_of_name(name) in months}
    headers = profile(spark, list(files.values())) if files else {}
    groups: dict[tuple[str, ...], list[str]] = {}
    for name in files:
        if headers.get(name) is not None:
            groups.setdefault(headers[name], []).append(files[name])
    rest = [files[name] for name in files if name in headers and headers[name] is None]
    parts = [_native(spark, paths, header, spec) for header, paths in groups.items()]
    if rest or not parts:
        parts.append(_decoded(spark, rest, spec))
    return reduce(DataFrame.unionByName, parts)


def read_sources(spark: SparkSession, roots: dict[str, str], specs: Sequence[config.SourceSpec] = config.SOURCES, report: BuildReport | None = None, months: Collection[str] | None = None) -> DataFrame:
    """All sources in the order of the registry; ``ingest_ord`` follows source, file name and row.

    ``roots`` maps source names to folders; a source without one is skipped with a
    warning. With ``months`` only the files of those months are read. A name's date
    need not be one that the calendar has; it stays as written.
    """
    parts = []
    for spec in specs:
        if spec.name in roots:
            parts.append(read_source(spark, roots[spec.name], spec, report, months))
        elif report is not None:
            report.warnings.append(f"no folder given for {spec.name}")
    every = union_sources(parts)
    # A place in the order without a sort: source, day and row fit in one number.
    # The eight digits of a name's date count up as names do, whether a calendar has that date or not.
    day = F.coalesce(F.replace("date", F.lit("-"), F.lit("")).try_cast("bigint"), F.lit(0))
    place = F.col("source_ord") * F.lit(1 << 57) + day * F.lit(1 << 30) + F.col("row")
    return every.withColumn("ingest_ord", place).drop("source_ord", "file_name", "row")
