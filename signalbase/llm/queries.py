"""The thin queries over this subpackage's operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from signalbase.llm import audit, avi, divergence, html, licenses, lm, mixing, packing, pii, quality, secrets, simhash, warc
from signalbase.llm.common import table


def tokenizer_path() -> str:
    """The vocabulary file of the packing query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = avi.write_avi(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return avi.read_avi(written).withColumn("feature", avi.feature()).drop("clips")


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_pii(table(spark, sf_dir, "documents")))


def op4_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "positions", "text_hash")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), model).drop("text_hash")


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.log_likelihood(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_avi_shots": op1_avi_shots,
    "op2_pii_bootstrap": op2_pii_bootstrap,
    "op3_quality_rules": op3_quality_rules,
    "op4_tag_path_text": op4_tag_path_text,
    "op5_mixing": op5_mixing,
    "op6_secret_forest": op6_secret_forest,
    "op7_license_digests": op7_license_digests,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_lm_scores": op12_lm_scores,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality.oracle(),
    "op5_mixing": mixing.oracle(),
    "op7_license_digests": licenses.oracle(),
    "op8_warc": warc.ORACLE,
    "op11_filter_audit": audit.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
