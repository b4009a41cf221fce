"""Keyword containment as a join: which of very many terms each text holds.

A text is cut into words at white space. A term that holds no white space stands
in a text only if it stands in one of its words, so terms are looked for in the
vocabulary of all texts, each word once, however many texts have it; texts meet
the outcome by their words. Of a term with white space its longest part is looked
for so, and what meets is verified in the text.

In the vocabulary each part is filed under one of its grams, the one that fewest
parts share: grams of six letters, of three for shorter parts, and of the part
itself below that. A word meets the parts filed under its own grams by equality,
and what meets is verified. Nothing is compared all with all and terms are rows
of a table, so a hundred thousand of them make no longer plan than one. Tables
that are small enough by count are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions.classify import confidence
from signalbase.functions.text import blank_to
from signalbase.sources.shared import staged

GRAM = 3
#: Letters of the grams that terms are filed under, the longest that a term has.
SIZES = (2 * GRAM, GRAM)
#: Where words end: white space and the marks that end clauses without it.
WORD_END = r"[\s\u3000\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]"
#: Terms that are broadcast at most; one takes about 100 bytes.
BROADCAST_TERMS = 500_000


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters; found by one pass of a regular expression, in linear time."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def leaf_table(spark: SparkSession, leaves: Sequence[config.Leaf]) -> DataFrame:
    """Leaves as rows (ord, name, keywords, path), as ``classify`` takes them."""
    rows = [(k, leaf.name, list(leaf.keywords), list(leaf.path)) for k, leaf in enumerate(leaves)]
    return spark.createDataFrame(rows, "ord long, name string, keywords array<string>, path array<string>")


def leaf_terms(leaves: DataFrame) -> DataFrame:
    """(term, ord, name, weight): 3 for each keyword and 1 for each part of the path, in lower case."""
    parts = [leaves.select(F.explode(c).alias("term"), "ord", "name", F.lit(w).alias("weight")) for c, w in (("keywords", 3), ("path", 1))]
    lowered = parts[0].unionByName(parts[1]).withColumn("term", F.lower("term")).filter("term <> ''")
    return lowered.groupBy("term", "ord", "name").agg(F.sum("weight").alias("weight"))


def longest_part(term: Column) -> Column:
    """The longest run of a term that no word end cuts; empty where there is none."""
    return F.array_max(F.transform(F.split(term, WORD_END, -1), lambda p: F.struct(F.length(p).alias("n"), p.alias("part"))))["part"]


def index(terms: DataFrame) -> DataFrame:
    """(gram, term): each distinct term under the gram that fewest terms share."""
    distinct = terms.select("term").distinct()
    each = F.array("term")
    for size in sorted(SIZES):
        each = F.when(F.length("term") >= size, grams(F.col("term"), size)).otherwise(each)
    held = distinct.select("term", F.explode(each).alias("gram"))
    shared = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A gram is spread over its terms by adaptive execution where very many share it.
    return held.join(shared, "gram").groupBy("term").agg(F.min(F.struct("n", "gram")).alias("least")).select("least.gram", "term")


def _in_words(vocabulary: DataFrame, parts: DataFrame, broadcast_terms: int) -> DataFrame:
    """(word, parts): of distinct words those that hold any of some parts (term), with them."""
    filed = staged(index(parts), "terms-filed")
    known = filed.groupBy(F.length("gram").alias("size")).agg(F.count("*").alias("n")).collect()
    sizes = sorted(r["size"] for r in known) or [GRAM]
    every = F.concat(*(grams(F.col("word"), s) for s in sizes))
    if sum(r["n"] for r in known) <= broadcast_terms:
        met = vocabulary.select("word", F.explode(every).alias("gram")).join(F.broadcast(filed), "gram")
    else:
        # A word travels once, however many grams it has; equal hashes are told apart by the words themselves.
        hashed = vocabulary.select(F.xxhash64("word").alias("h"), F.explode(every).alias("gram"))
        near = hashed.join(filed, "gram").select("h", "term").distinct()
        met = vocabulary.withColumn("h", F.xxhash64("word")).join(near, "h")
    return met.filter(F.contains("word", F.col("term"))).groupBy("word").agg(F.collect_set("term").alias("parts"))


def contained(texts: DataFrame, key: Sequence[str], text: Column, terms: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(key, term): the terms (of a column ``term``, in lower case) that each text holds, once each.

    Rows of equal key count as one text each: a term comes once a key. A null
    text holds nothing.
    """
    listed = staged(terms.select("term").distinct().withColumn("part", longest_part(F.col("term"))), "terms")
    cut, blank = listed.agg(F.count_if(F.col("part") != F.col("term")), F.count_if(F.col("part") == "")).first()
    own = texts.select(*key, F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    # Each text has the empty word, which terms without any part are filed under.
    words = own.select(*key, F.explode(F.array_union(F.split("_low", WORD_END, -1), F.array(F.lit("")))).alias("word"))
    found = _in_words(words.select("word").distinct(), listed.filter("part <> ''").select(F.col("part").alias("term")), broadcast_terms)
    if blank:
        found = found.unionByName(found.sparkSession.range(1).select(F.lit("").alias("word"), F.array(F.lit("")).alias("parts")))
    found = staged(found, "terms-words")
    small = found.agg(F.sum(F.size("parts"))).first()[0] or 0
    met = words.join(F.broadcast(found) if small <= broadcast_terms else found, "word").select(*key, F.explode("parts").alias("term")).distinct()
    if not cut:
        return met
    near = met.withColumnRenamed("term", "part").join(listed, "part")
    whole = near.filter("part = term").select(*key, "term")
    near = near.filter("part <> term").select(*(F.col(k).alias(f"_{k}") for k in key), "term")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return whole.unionByName(own.join(near, same).filter(F.contains("_low", F.col("term"))).select(*key, "term")).distinct()


def classify(texts: DataFrame, key: Sequence[str], text: Column, leaves: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(key, category, score, confidence) of the best leaf of each key; of equal scores the first leaf's.

    ``leaves`` holds (ord, name, keywords, path). The same results as
    ``functions.classify.classify_leaf``, which is the better choice for a
    taxonomy small enough to be a literal, as it needs no shuffle at all.
    """
    weights = leaf_terms(leaves)
    hits = contained(texts, key, text, weights, broadcast_terms).join(weights, "term")
    scored = hits.groupBy(*key, "ord", "name").agg(F.sum("weight").alias("score"))
    none = texts.select(*key, F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("score"))
    best = scored.unionByName(none).groupBy(*key).agg(F.max(F.struct("score", (-F.col("ord")).alias("order"), "name")).alias("best"))
    score = F.col("best.score").cast("double")
    name = F.when(score > 0, F.col("best.name")).otherwise(config.UNCLASSIFIED)
    return best.select(*key, name.alias("category"), score.alias("score"), confidence(score).alias("confidence"))


def named_leaves(rows: DataFrame) -> DataFrame:
    """Leaves of a taxonomy read as rows (ord, label, path, keywords), with their names."""
    path = blank_to(F.concat_ws("-", "path"), "")
    return rows.select("ord", F.coalesce(F.nullif(path, F.lit("")), F.nullif("label", F.lit("")), F.lit(config.UNCLASSIFIED)).alias("name"), "keywords", "path")
