"""Records: assembly, order, union, carry-forward of earlier classifications."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbase import config, schema
from signalbase.functions import classify, extract, text



def newest_first() -> tuple[Column, Column, Column]:
    """Sort keys of the record order; ``ingest_ord`` makes it total."""
    return F.desc("date"), F.desc("title"), F.asc("ingest_ord")


def build_records(rows: DataFrame, leaves: Sequence[config.Leaf] = (), extract_params: bool = False, classify_text: bool = False, alert_terms: Sequence[str] = config.ALERT_TERMS) -> DataFrame:
    """Records with all fields from (title, authors, body, url, date, source, intelligence_type, ingest_ord).

    By default no parameters are extracted and nothing is classified.
    """
    joined = F.concat_ws(" ", F.col("title"), F.col("body"))
    params = extract.extract_params(joined) if extract_params else F.array().cast(schema.RECORD["key_parameters"].dataType)
    out = rows.withColumn("key_parameters", params)
    best = classify.classify_leaf(F.concat_ws(" ", "title", "body"), leaves) if classify_text else None
    if best is not None:
        out = out.withColumn("_best", best)
    return out.select(
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "authors", "body")),
        (F.col("_best.category") if best is not None else F.lit(config.UNCLASSIFIED)).alias("category"),
        "date",
        "source",
        "url",
        "intelligence_type",
        classify.alert_flag(F.col("title"), F.col("body"), F.col("key_parameters") if extract_params else None, alert_terms).alias("is_alert"),
        "key_parameters",
        text.content_hash(F.col("title"), F.col("body"), F.col("authors"), F.col("url")).alias("content_hash"),
        (F.col("_best.confidence") if best is not None else F.lit(0.0)).alias("classification_confidence"),
        F.lit("keyword_score" if best is not None else config.DEFAULT_REASON).alias("classification_reason"),
        F.lit(False).alias("cache_hit"),
        F.lit(None).cast("string").alias("classifier_model"),
        F.lit(None).cast("string").alias("classifier_provider"),
        "ingest_ord",
    )


def sorted_records(records: DataFrame) -> DataFrame:
    return records.orderBy(*newest_first())


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several sources, in their order: ``ingest_ord`` is a source's place, then a row's in it."""
    tagged = [p.withColumn("source_ord", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def carry_eligible(prior: DataFrame, models: Sequence[str] = config.TRUSTED_MODELS) -> DataFrame:
    """Earlier records whose classification may be carried forward."""
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return prior.filter(present("content_hash") & F.col("classifier_model").isin(list(models)) & present("category") & (F.col("category") != config.UNCLASSIFIED))


def carry_dedupe(eligible: DataFrame) -> DataFrame:
    """One row a hash: that of the latest month, then of the highest place."""
    kept = F.struct("category", "classification_confidence", "classification_reason", "classifier_model", "classifier_provider")
    best = eligible.groupBy("content_hash").agg(F.max_by(kept, F.struct(text.month_key(F.col("date")), F.col("ingest_ord"))).alias("kept"))
    return best.select("content_hash", "kept.*")


def carry_forward(records: DataFrame, prior: DataFrame, models: Sequence[str] = config.TRUSTED_MODELS) -> DataFrame:
    """``records`` with the fields of earlier classifications of equal content.

    The cache holds a row for each text ever classified, so it is joined by
    hash; Spark broadcasts it where its size at run time allows.
    """
    return overlay(records, carry_dedupe(carry_eligible(prior, models)))


def overlay(records: DataFrame, known: DataFrame) -> DataFrame:
    """``records`` with the classifications of ``known``, which has one row a content hash."""
    kept = known.select(
        "content_hash",
        F.struct(
            "category",
            F.coalesce("classification_confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("classification_reason", F.lit("")).alias("reason"),
            "classifier_model",
            "classifier_provider",
        ).alias("_kept"),
    )
    hit = F.col("_kept").isNotNull()
    take = lambda field, own: F.when(hit, F.col(f"_kept.{field}")).otherwise(F.col(own))
    joined = records.join(kept, "content_hash", "left")
    none = F.array().cast(schema.RECORD["key_parameters"].dataType)
    return joined.select(
        *(
            {
                "category": take("category", "category"),
                "classification_confidence": take("confidence", "classification_confidence"),
                "classification_reason": take("reason", "classification_reason"),
                "classifier_model": take("classifier_model", "classifier_model"),
                "classifier_provider": take("classifier_provider", "classifier_provider"),
                "key_parameters": F.when(hit, none).otherwise(F.col("key_parameters")),
                "cache_hit": F.when(hit, False).otherwise(F.col("cache_hit")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in records.columns
        )
    )
