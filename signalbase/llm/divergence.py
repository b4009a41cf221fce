"""How far the sources of a language diverge in their terms, by wide term vectors.

A term of a language is one row: a vector of counts indexed by the language's
sources. Smoothed shares p are exact integers, p = 1 + floor(10^9 (count + 1) /
(N + V)), and two sources diverge in a term by floor((p - q)^2 / q). Higher-order
functions emit a vector's contributions to pairs of sources and Spark adds them
up where they lie. Most terms occur in few sources, so a vector emits only pairs
that both have the term (``pair_sums`` says how the others are added, exactly).

Defined results: null text, lang and source count as ''. Rows that repeat count
each for itself, as documents of their own. A language without kept terms gives
its pairs with 0; one with a single source gives no pairs. No rows give no rows.
Ties rank by the item's UTF-8 bytes. Other columns are not read, whatever their
names. A text is held whole by the task that reads it, its terms in blocks.
Sums are of 64 bits: they hold while V is below 10^9.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbase.llm.common import by_size, staged, word_blocks

#: Fixed values of the contract.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: ASCII letters in lower case, other ASCII characters as spaces; bytes of other characters stay.
TERM_BYTES = bytes(b | 32 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))
#: Entries that a task gathers before it sends them on.
GATHERED = 500_000
#: Groups of which the languages' lists of sources are broadcast; a group takes some 50 bytes there.
BROADCAST_GROUPS = 1_000_000

_SCHEMA = "lang string, term string, docs long, counts array<struct<source:string,n:long>>"
_ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("counts", pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())])))])


def _gathered(counts: dict[tuple[str, str], Counter], docs: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """Partial term vectors: the entries of a language's sources, brought together by the terms' numbers."""
    for lang, seen in docs.items():
        number = {term: k for k, term in enumerate(seen)}
        own = [(source, terms) for (of, source), terms in counts.items() if of == lang]
        at = np.concatenate([np.fromiter(map(number.__getitem__, terms), np.int64, len(terms)) for _, terms in own])
        n = np.concatenate([np.fromiter(terms.values(), np.int64, len(terms)) for _, terms in own])
        sources = pa.array([source for source, _ in own], pa.string()).take(pa.array(np.repeat(np.arange(len(own)), [len(terms) for _, terms in own])))
        order = np.argsort(at, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(number)))])
        entries = pa.StructArray.from_arrays([sources.take(pa.array(order)), pa.array(n[order])], ["source", "n"])
        vectors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
        columns = [pa.array([lang] * len(number), pa.string()), pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64()), vectors]
        whole = pa.RecordBatch.from_arrays(columns, schema=_ARROW)
        yield from (whole.slice(at, 10_000) for at in range(0, whole.num_rows, 10_000))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[str, Counter] = {}
    for batch in by_size(batches):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            in_text: set[bytes] = set()
            here = counts.setdefault((lang, source), Counter())
            for block in word_blocks(text.translate(TERM_BYTES)):
                here.update(block)
                in_text.update(block)
            docs.setdefault(lang, Counter()).update(in_text)
        if sum(map(len, counts.values())) > GATHERED:
            yield from _gathered(counts, docs)
            counts, docs = {}, {}
    yield from _gathered(counts, docs)


def term_vectors(docs: DataFrame) -> DataFrame:
    """(lang, term, counts array of struct(source, n)) of the terms in at least three documents of their language.

    Tasks send a term's partial vector once for each half million entries they
    gather, so even a term of every document is few rows. Both groupings use the
    one shuffle by language and term.
    """
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = texts.mapInArrow(_vectors, _SCHEMA).repartition("lang", "term")
    # A term's documents stand on the first entry of its partial vector.
    entries = parts.select("lang", "term", "docs", F.posexplode("counts").alias("at", "entry"))
    summed = entries.groupBy("lang", "term", "entry.source").agg(F.sum("entry.n").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    vectors = summed.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return vectors.filter(F.col("docs") >= LEAST_DOCS).drop("docs")


def languages(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row a language: V, N of the language, and its sources in order with the N of each."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    totals = vectors.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    kept = vectors.groupBy("lang").agg(F.count("*").alias("v"))
    sized = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    by_lang = sized.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"))
    return by_lang.join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count: by 64-bit integers where they hold it, by decimals beyond. Where there are no terms nothing uses it."""
    size = F.greatest(total + terms, F.lit(1).cast("long"))
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), size.cast("decimal(20,0)"))
    return F.when(count < 9_000_000_000, 1 + F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), size)).otherwise(1 + wide)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def wide(vectors: DataFrame, langs: DataFrame) -> DataFrame:
    """Each term with its ``vector`` of struct(i, n, p) by places in the language's ``names``; ``zero`` holds each place's p of a count of 0."""
    none = F.lit(0).cast("long")
    lists = langs.select("lang", "n_lang", "v", F.col("sources.source").alias("names"), F.col("sources.n").alias("sizes"), F.transform("sources", lambda s: share(none, s["n"], F.col("v"))).alias("zero"))
    small = langs.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0] <= BROADCAST_GROUPS
    rows = vectors.join(F.broadcast(lists) if small else lists, "lang")
    placed = F.transform("counts", lambda c: F.struct((F.array_position("names", c["source"]) - 1).cast("int").alias("i"), c["n"].alias("n")))
    vector = F.transform(placed, lambda e: F.struct(e["i"].alias("i"), e["n"].alias("n"), share(e["n"], F.get("sizes", e["i"]), F.col("v")).alias("p")))
    return rows.select("lang", "term", "n_lang", "v", "names", "zero", vector.alias("vector"))


def pair_sums(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source beside each other one of its language.

    With 0 for a place's p of no occurrence, f(a, b) is the sum of f(0, 0), of
    f(a, 0) - f(0, 0), of f(0, b) - f(0, 0) and of the rest. The first is added V
    times a pair; the next two depend on one place and its count and are added
    once for each count, times the terms that have it; the rest is 0 unless both
    places have the term, and only those pairs are emitted.
    """
    beside = F.flatten(F.transform("vector", lambda a: F.transform(F.filter("vector", lambda b: b["i"] != a["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), a["p"].alias("p"), b["p"].alias("q")))))
    emitted = rows.select("lang", "zero", F.explode(beside).alias("e")).select("lang", "e.*", F.get("zero", F.col("e.i")).alias("p0"), F.get("zero", F.col("e.j")).alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    shared = emitted.groupBy("lang", "i", "j").agg(F.sum(distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)).alias("d"))

    counts = rows.select("lang", F.explode("vector").alias("e")).groupBy("lang", "e.i", "e.n").agg(F.count("*").alias("times"))
    places = langs.select("lang", "v", F.posexplode("sources").alias("i", "mine"))
    zero = share(F.lit(0).cast("long"), F.col("mine.n"), F.col("v"))
    zeros = langs.select("lang", F.transform("sources", lambda s: share(F.lit(0).cast("long"), s["n"], F.col("v"))).alias("zero"))
    known = counts.join(places.withColumn("p0", zero), ["lang", "i"]).join(zeros, "lang")
    alone = known.select("lang", "i", "times", share(F.col("n"), F.col("mine.n"), F.col("v")).alias("p"), "p0", F.posexplode("zero").alias("j", "q0")).filter("i != j")
    alone = alone.groupBy("lang", "i", "j").agg(
        F.sum(F.col("times") * (distance(p, q0) - distance(p0, q0))).alias("d"),
        F.sum(F.col("times") * (distance(q0, p) - distance(q0, p0))).alias("back"),
    )
    added = shared.unionByName(alone.select("lang", "i", "j", "d")).unionByName(alone.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), F.col("back").alias("d")))
    added = added.groupBy("lang", "i", "j").agg(F.sum("d").alias("d"))

    pairs = langs.select("lang", "v", "sources", F.posexplode("sources").alias("i", "mine")).select("lang", "v", "i", "mine", F.posexplode("sources").alias("j", "other")).filter("i != j")
    base = F.col("v") * distance(zero, share(F.lit(0).cast("long"), F.col("other.n"), F.col("v")))
    value = base + F.coalesce("d", F.lit(0).cast("long"))
    return pairs.join(added, ["lang", "i", "j"], "left").select("lang", F.col("mine.source").alias("source"), F.col("other.source").alias("item"), value.alias("value"))


def leading_terms(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms a source has in a larger share than its language."""
    all_n = F.aggregate("vector", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    rows = rows.select("lang", "term", "names", "vector", share(all_n, F.col("n_lang"), F.col("v")).alias("q"))
    over = rows.select("lang", "term", "names", "q", F.explode("vector").alias("e")).filter(F.col("e.p") > F.col("q"))
    return over.select("lang", F.get("names", F.col("e.i")).alias("source"), F.col("term").alias("item"), distance(F.col("e.p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """Pairs of sources and leading terms, ranked.

    The ranks of terms are cut at 200 before the shuffle, group by group, as
    Spark does with a limit on row numbers; a group of pairs has one row a source.
    """
    vectors = staged(term_vectors(docs), "term-vectors")
    langs = staged(languages(docs, vectors), "term-languages")
    rows = wide(vectors, langs)

    def ranked(df: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pair_sums(rows, langs), "pair").unionByName(ranked(leading_terms(rows), "term").filter(F.col("rank") <= TOP))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT row_id, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), size AS (
  SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups LEFT JOIN c USING (lang, source) GROUP BY ALL
), vocabulary AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang
), p AS (
  SELECT size.lang, size.source, kept.term, coalesce(c.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (size.n + vocabulary.v) AS p,
    1 + (1000000000::HUGEINT * (kept.c + 1)) // (vocabulary.n + vocabulary.v) AS q
  FROM size JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN c ON c.lang = size.lang AND c.source = size.source AND c.term = kept.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every_pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), every_row AS (
  SELECT lang, source, 'pair' AS part, item, value FROM every_pair
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every_row
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
