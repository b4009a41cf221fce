"""Audit of how five filters interact, by Walsh-Hadamard sums.

A text's failures are a mask of five bits. For each part and label (all
documents, good ones, toxic ones) 32 signed parity sums are aggregated: the sum
with number u counts a document +1 or -1 as its mask and u share an even or odd
number of bits. The transform inverts exactly to the number of documents of each
mask, and from these 32 cells every order of the filters is read off: what a
filter removes, what another has removed before it, and its Shapley count, for a
document that fails k filters is removed by each of them in 120 / k orders.

Defined results: a null text counts as empty, a null ``part`` as ''; a null label
is no label, and a document with several label rows bears all their labels. Rows
that repeat count each for itself; rows of one id and one text are no smaller
than each other, so none fails filter E through the other. A null id is neither
smaller nor larger than any, and bears no label. No rows give no rows. Other
columns are not read, whatever their names. A text is held whole by the task that
reads it, its words in blocks, and the distinct ones in a set.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbase.llm.common import by_size, word_blocks

FILTERS = "ABCDE"
#: Fixed values of the contract: fewest words, least share of distinct words and largest share of capitals in per cent.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 100, 80, 10
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = b"#$%&*|"
CELLS = 1 << len(FILTERS)
DUPLICATE = 1 << FILTERS.index("E")
LABELS = ("every", "good", "toxic")


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text in UTF-8 fails."""
    n_words, distinct = 0, set()
    for block in word_blocks(text):
        n_words += len(block)
        distinct.update(block)
    points = len(text) - len(text.translate(None, bytes(b for b in range(256) if not 0x80 <= b < 0xC0)))
    tests = (
        n_words < LEAST_WORDS,
        100 * len(distinct) < DISTINCT_SHARE * n_words,
        100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_SHARE * points,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << k for k, failed in enumerate(tests) if failed)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        made = [pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *made], names=["doc_id", "part", "mask", "key"])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by the filters they fail and the labels they bear.

    Texts do not travel, only their digests do, and equal rows are added up
    before they do. A digest's rows are one for each part and pair of labels
    when its smallest id is looked for, so no group of copies meets in one task.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).cast("string").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("key", T.BinaryType())])
    own = rows.mapInArrow(_masks, schema).groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("copies"))

    flags = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")]
    marked = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("_id")).agg(*flags)
    no = F.lit(False)
    known = own.filter("doc_id is not null").join(marked, F.col("doc_id") == F.col("_id"), "left")
    known = known.select("doc_id", "key", "part", "mask", "copies", F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    nameless = own.filter("doc_id is null").select("doc_id", "key", "part", "mask", "copies", no.alias("good"), no.alias("toxic"))

    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "copies"))).alias("least")
    free = F.sum(F.when(F.col("doc_id").isNull(), F.col("copies")).otherwise(0)).alias("free")
    groups = known.unionByName(nameless).groupBy("key", "part", "mask", "good", "toxic").agg(F.sum("copies").alias("n"), least, free)
    by_text = groups.groupBy("key").agg(F.min("least.doc_id").alias("first"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "least", "free")).alias("all"))
    g = by_text.select("first", F.explode("all").alias("g")).select("first", "g.*")
    passing = F.col("free") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.copies")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct((F.col("mask") + DUPLICATE).alias("mask"), (F.col("n") - passing).alias("n")))
    cells = g.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "c.mask", "good", "toxic", "c.n").filter("n > 0")
    return cells.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def parity_sums(counts: DataFrame) -> DataFrame:
    """(part, label, sums): for each u in 0..31 the documents with even less those with odd parity of mask & u."""
    labels = F.array_compact(F.array(F.lit(LABELS[0]), F.when(F.col("good"), LABELS[1]), F.when(F.col("toxic"), LABELS[2])))
    rows = counts.select("part", "mask", "n", F.explode(labels).alias("label"))
    signed = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(u))) % 2 == 0, F.col("n")).otherwise(-F.col("n"))) for u in range(CELLS)]
    return rows.groupBy("part", "label").agg(F.array(*signed).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, every, good, toxic): documents of each mask, the sums transformed back; the division by 32 leaves no rest."""
    back = F.expr(f"transform(sequence(0, {CELLS - 1}), m -> aggregate(sequence(0, {CELLS - 1}), 0L, (a, u) -> a + if(bit_count(m & u) % 2 = 0, sums[u], -sums[u])) div {CELLS})")
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    wide = [F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), none).alias(x) for x in LABELS]
    return sums.select("part", "label", back.alias("cells")).groupBy("part").agg(*wide)


def steps() -> list[dict]:
    """The steps of all orders: the filter's bit and the bits of those before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[x] for x in order), "step": k + 1, "bit": 1 << f, "before": sum(1 << x for x in order[:k])})
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step, with the contract's counts."""
    each = F.from_json(F.lit(json.dumps(steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = cells(parity_sums(masks(docs, labels))).select("*", F.explode(each).alias("s")).select("part", *LABELS, "s.*")

    def total(cell: str, condition: str, term: str = "{c}[m]"):
        value = term.format(c=cell)
        return F.expr(f"aggregate(sequence(0, {CELLS - 1}), 0L, (a, m) -> a + if({condition}, {value}, 0L))")

    fails, first = "(m & bit) != 0", "(m & bit) != 0 and (m & before) = 0"
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("every", "(m & (bit | before)) = 0").alias("kept"),
        total("every", first).alias("removed"),
        total("every", "(m & bit) != 0 and (m & before) != 0").alias("redundant"),
        F.expr("every[bit]").alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        total("every", fails, "{c}[m] * (120L div bit_count(m))").alias("shapley"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failed AS (
  SELECT doc_id, part,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask
  FROM docs
), marked AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM failed LEFT JOIN marked USING (doc_id) GROUP BY ALL
), f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, f.bit,
    (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE position(g.name IN filter_order) < step)::INT AS before
  FROM orders, range(1, 6) r(step), f WHERE f.name = filter_order[step]
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER ((mask & (bit | before)) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER ((mask & bit) != 0 AND (mask & before) = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER ((mask & bit) != 0 AND (mask & before) != 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER ((mask & bit) != 0 AND (mask & before) = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(bad) FILTER ((mask & bit) != 0 AND (mask & before) = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER ((mask & bit) != 0), 0)::BIGINT AS shapley
FROM cells, steps GROUP BY part, filter_order, step
"""
