"""Quality rules: a threshold table compiled into one projection.

Every feature and the verdict are built-in expressions of a single
projection over the text: no shuffle, no user function.

Defined cases: a null, empty or blank text has no word and fails; a text of
under three words has no window; ties and repeated rows are judged row by
row; an empty table gives an empty result. Further columns of the input are
kept, unless they bear the name of a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbase.llm.common import SPACE, let, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der die ein eine für in ist mit nicht sich und von zu "
    "au avec dans de des du elle en est et il la le les pas pour que qui un une "
    "con del el en es la las lo los mi no para por que se su un una y"
).split()

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A text passes if ``least <= value <= most``; a missing bound does not bind."""

    name: str
    value: str  # SQL over the features
    least: float | None = None
    most: float | None = None

    def passed(self) -> Column:
        value = F.expr(self.value)
        checks = [value >= self.least] * (self.least is not None) + [value <= self.most] * (self.most is not None)
        out = F.lit(True)
        for check in checks:
            out = out & check
        return F.coalesce(out, F.lit(False))


RULES = (
    Rule("mean word length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols per word", "n_symbols / n_words", most=0.1),
    Rule("stop words per word", "n_stop_words / n_words", least=0.06),
    Rule("repeated lines per line", "n_dup_lines / n_lines", most=0.5),
)

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window which the text has at least twice.

    Windows are compared by hash first, and as text only where hashes meet.
    """

    def sorted_by(key: Callable[[Column], Column], places: Column) -> Column:
        return F.sort_array(F.transform(places, lambda i: F.struct(key(i).alias("key"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["key"] == F.get(s, k)["key"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.transform(places, lambda j: s[j]["i"])

    def covered(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    def count(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("key"), i.alias("i"))))
        by_text = let(let(by_hash, repeated), lambda at: sorted_by(lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]), at))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(let(by_text, repeated)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, 0).otherwise(let(hashes, count))


def features(text: Column) -> Column:
    """All counts of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
        out = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(text, SPACE, "")),
            "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": _repeat_words(w),
            "n_lines": F.size(lines),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in out.items()))

    return let(words(text), counts)


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the features, ``base_failed`` and ``kept``."""
    own = [c for c in df.columns if c not in {*FEATURES, "_quality", "base_failed", "kept"}]
    counted = df.select(*own, features(F.col(text)).alias("_quality")).select(*own, *(F.col("_quality")[c].alias(c) for c in FEATURES))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = ~failed
    for rule in rules:
        verdict = F.when(verdict, rule.passed()).otherwise(False)
    return counted.withColumn("base_failed", failed).withColumn("kept", verdict)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the query op3, from the same table of rules."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = " AND ".join(f"coalesce({r.value} >= {r.least}, false)" for r in rules if r.least is not None)
    checks += " AND " + " AND ".join(f"coalesce({r.value} <= {r.most}, false)" for r in rules if r.most is not None)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len([x FOR x IN w IF lower(x) IN ({stop})]) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND {checks} AS kept FROM b"""
