"""Keyword classification, alerts, and guards around model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions.text import blank_to, normalize_category


def confidence(score: Column) -> Column:
    """min(0.95, 0.45 + score / 20); 0 without a hit."""
    return F.when(score > 0, F.least(F.lit(0.95), F.lit(0.45) + score / 20)).otherwise(F.lit(0.0))


def classify_leaf(text: Column, leaves: Sequence[config.Leaf]) -> Column:
    """struct(category, score, confidence) of the best leaf.

    A leaf scores 3 for each keyword and 1 for each part of its path that the
    text holds, case apart; of equal scores the first leaf wins. The leaves are
    literals and the test is local to the row: nothing is joined.
    """
    table = F.array(
        *(
            F.struct(
                F.lit(-k).alias("order"),
                F.lit(leaf.name).alias("name"),
                *(F.array(*(F.lit(t.lower()) for t in terms if t)).cast("array<string>").alias(part) for part, terms in (("keywords", leaf.keywords), ("path", leaf.path))),
            )
            for k, leaf in enumerate(leaves)
        )
    )

    def best(low: Column) -> Column:
        hits = lambda terms: F.size(F.filter(terms, lambda t: F.contains(low, t)))
        scored = F.transform(table, lambda x: F.struct((3 * hits(x["keywords"]) + hits(x["path"])).alias("score"), x["order"].alias("order"), x["name"].alias("name")))
        return F.array_max(scored)

    # One-element transforms bind a value once a row.
    bind = lambda value, body: F.transform(F.array(value), body)[0]
    named = lambda b: F.struct(
        F.when(b["score"] > 0, b["name"]).otherwise(config.UNCLASSIFIED).alias("category"),
        b["score"].cast("double").alias("score"),
        confidence(b["score"].cast("double")).alias("confidence"),
    )
    if not leaves:
        return F.struct(F.lit(config.UNCLASSIFIED).alias("category"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"))
    return bind(F.lower(F.coalesce(text, F.lit(""))), lambda low: bind(best(low), named))


def alert_flag(title: Column, body: Column, params: Column | None = None, terms: Sequence[str] = config.ALERT_TERMS) -> Column:
    """Whether title or body holds any of the terms, or there are parameters."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    hit = F.transform(F.array(low), lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t)))[0]
    return hit if params is None else hit | (F.coalesce(F.size(params), F.lit(0)) > 0)


def vocab_guard(category: Column, vocabulary: Sequence[str]) -> Column:
    """A model's category in stored form; what is not in the vocabulary, as written there, is unrelated."""
    known = F.coalesce(category.isin(list(vocabulary)), F.lit(False))
    return normalize_category(F.when(known, category).otherwise(config.UNRELATED))


def _salvaged(text: Column, first: str, last: str) -> Column:
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*`+(?:json\n|\n)?|`+\s*$", ""))
    inner = F.regexp_extract(bare, rf"(?s)\{first}.*\{last}", 0)
    return F.coalesce(F.nullif(inner, F.lit("")), bare)


def _typed(result: Column) -> Column:
    """An element as struct(id, category, confidence, reason); null what it has not got, or not in that type."""
    field = lambda name, kind: F.try_variant_get(result, f"$.{name}", kind).alias(name)
    return F.struct(field("id", "bigint"), field("category", "string"), field("confidence", "double"), field("reason", "string"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _only(text: Column) -> Column:
    """The one JSON value of a text; null where there is none, or more than one."""
    # The parser stops after a value; as an element of an array, what follows is seen.
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(values) == 1, values[0])


def parse_model_array(text: Column) -> Column:
    """The objects of the JSON array in a model's answer, code fences and chatter stripped; null where it is no JSON array.

    Elements that are no objects are left out and fields of another type are
    null, so one misshapen element does not lose the batch. What names a key
    twice is no JSON here.
    """
    elements = F.try_variant_get(_only(_salvaged(text, "[", "]")), "$", "array<variant>")
    return F.transform(F.filter(elements, _is_object), _typed)


def parse_model_object(text: Column) -> Column:
    """The JSON object in a model's answer; null where it is none."""
    parsed = _only(_salvaged(text, "{", "}"))
    return F.when(_is_object(parsed), _typed(parsed))


def coerced(result: Column, vocabulary: Sequence[str]) -> Column:
    """struct(category, confidence, reason) of a model's result, guarded, with defaults."""
    return F.struct(
        vocab_guard(result["category"], vocabulary).alias("category"),
        F.coalesce(result["confidence"], F.lit(0.0)).alias("confidence"),
        blank_to(result["reason"], "").alias("reason"),
    )
