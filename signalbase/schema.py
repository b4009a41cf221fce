"""Row types of the engine."""

from pyspark.sql import types as T

PARAM = T.StructType(
    [
        T.StructField("value_raw", T.StringType()),
        T.StructField("value_numeric", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("evidence_text", T.StringType()),
        T.StructField("extraction_reason", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

RECORD = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("title", "authors", "body", "category", "date", "source", "url", "intelligence_type")),
        T.StructField("is_alert", T.BooleanType()),
        T.StructField("key_parameters", T.ArrayType(PARAM)),
        T.StructField("content_hash", T.StringType()),
        T.StructField("classification_confidence", T.DoubleType()),
        T.StructField("classification_reason", T.StringType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("classifier_model", T.StringType()),
        T.StructField("classifier_provider", T.StringType()),
    ]
)

LEAF = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
    ]
)

TAXONOMY = T.StructType([T.StructField("version", T.StringType()), T.StructField("source", T.StringType()), T.StructField("leaves", T.ArrayType(LEAF))])
