"""A corpus from raw documents to packed sequences: five stages, each reading what the one before it has written.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame. All but the last return the columns of documents.
``run`` applies them to the documents of ``sf_dir``; between stages the rows
are written as Parquet in the shared folder and read again.

Rows with a null text do not outlive the quality rules. The secret scan masks
secrets in the texts it keeps. Mixing gives a document once for each time it
is taken, half a taking counting as one, in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase.llm import jaccard, mixing, packing, quality, secrets
from signalbase.llm.common import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.quality_rules(docs).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the forest confirms masked."""
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.redact(docs, model).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training positions."""
    return mixing.taken_rows(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("source mix", source_mix),
    ("packing", pack_sequences),
]

#: Neither the forest nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k + 1}-{name.replace(' ', '-')}")
    return docs
