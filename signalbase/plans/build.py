"""The build: CSV drops to a store, keeping earlier classifications; and its update by the months that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from signalbase import config
from signalbase.functions import text
from signalbase.operators.knowledge import knowledge_docs
from signalbase.operators.records import build_records
from signalbase.plans.stats import BuildReport
from signalbase.sources import state
from signalbase.sources.csv_drops import drop_files, read_sources
from signalbase.sources.store import FILES, generations, known_files, write_store


def _listed(spark: SparkSession, roots: dict[str, str], specs: Sequence[config.SourceSpec]) -> set[tuple[str, str, int, int]]:
    return {(s.name, name, size, changed) for s in specs if s.name in roots for _, name, size, changed in drop_files(spark, roots[s.name], s)}


def _ledger(spark: SparkSession, files: set[tuple[str, str, int, int]]) -> DataFrame:
    return spark.createDataFrame(sorted(files), FILES).coalesce(1)


def build(
    spark: SparkSession,
    roots: dict[str, str],
    folder: str,
    leaves: Sequence[config.Leaf] = (),
    taxonomy_version: str = "unknown",
    specs: Sequence[config.SourceSpec] = config.SOURCES,
    extract: bool = False,
    classify: bool = False,
    form: str = "parquet",
    keep: int | None = None,
) -> BuildReport:
    """Read all sources, overlay what the store at ``folder`` has classified, and write its next generation.

    What the store has classified comes from its state, into which the months
    written since the last build are merged first.
    """
    report = BuildReport(taxonomy_version)
    files = _listed(spark, roots, specs)
    known = state.refresh_state(spark, folder)
    records = build_records(read_sources(spark, roots, specs, report), leaves, extract, classify)
    carried = state.carry_from_state(records, known).persist()
    try:
        write_store(carried, folder, report, knowledge_docs(carried, leaves), form, keep, files=_ledger(spark, files))
    finally:
        carried.unpersist()
    return report


def update(
    spark: SparkSession,
    roots: dict[str, str],
    folder: str,
    leaves: Sequence[config.Leaf] = (),
    taxonomy_version: str = "unknown",
    specs: Sequence[config.SourceSpec] = config.SOURCES,
    extract: bool = False,
    classify: bool = False,
    keep: int | None = None,
) -> tuple[BuildReport, list[str]]:
    """Bring a store up to date with its drops by the months whose files came, went or changed; returns those months.

    A file's name gives the month of its records, so the other months' files and
    shards are not read, but for those written since the last build or update,
    whose classifications are merged into the state. New records are overlaid from it.
    Knowledge documents span all months and stay as the last ``build`` wrote them,
    in its own generation. A store without a list of its files is built as a whole.
    """
    before, files = known_files(spark, folder), _listed(spark, roots, specs)
    if before is None:
        report = build(spark, roots, folder, leaves, taxonomy_version, specs, extract, classify, keep=keep)
        return report, sorted({text.month_of_name(name) for _, name, _, _ in files})
    months = sorted({text.month_of_name(name) for _, name, _, _ in before ^ files})
    report = BuildReport(taxonomy_version)
    if not months:
        return report, []
    form = generations(spark, folder)[0]["form"]
    known = state.refresh_state(spark, folder)
    records = build_records(read_sources(spark, roots, specs, report, months), leaves, extract, classify)
    write_store(state.carry_from_state(records, known), folder, report, None, form, keep, months, _ledger(spark, files))
    return report, months
