"""Helpers that several text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase.sources.shared import shared_dir, staged

#: White space as the operators define it: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
#: Matches of a text that are gathered at a time.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The runs of characters other than white space, in order; null gives an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * (len(SPACE) - 1))
    return F.array_remove(F.split(flat, " "), "")


def found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as array of struct(start, end, match, before, after).

    Offsets count code points, the end is exclusive. ``before`` and ``after``
    are the pieces of text between a match and its neighbours. The pattern
    must not match the empty string. Splitting by a pattern and extracting it
    walk over the same leftmost, non-overlapping matches.
    """
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"

    def step(pieces: Column, matches: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(pieces[i])
            end = start + F.length(matches[i])
            one = F.struct(start.alias("start"), end.alias("end"), matches[i].alias("match"), pieces[i].alias("before"), pieces[i + 1].alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        # Appending copies, so matches are gathered by blocks and blocks are joined at the end.
        last = F.size(matches) - 1

        def add_block(acc: Column, base: Column) -> Column:
            block = F.sequence(base, F.least(base + F.lit(BLOCK - 1), last))
            start = F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out"))
            return let(F.reduce(block, start, add), lambda b: F.struct(b["at"].alias("at"), F.concat(acc["out"], F.array(b["out"])).alias("out")))

        blocks = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.reduce(F.sequence(F.lit(0), last, F.lit(BLOCK)), blocks, add_block, lambda acc: F.flatten(acc["out"]))

    def spans(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), lambda pieces: step(pieces, matches))).otherwise(F.array().cast(kind))

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans), F.array().cast(kind))


def by_size(batches: Iterator, rows: int = 256, size: int = 1 << 24) -> Iterator:
    """Arrow batches cut into slices of at most ``rows`` rows, halved while they hold more than ``size`` bytes and more than one row."""
    todo = []
    for batch in batches:
        todo.extend(batch.slice(at, rows) for at in reversed(range(0, batch.num_rows, rows)))
        while todo:
            part = todo.pop()
            if part.nbytes > size and part.num_rows > 1:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


#: Bytes of a text whose words are cut at a time.
WORD_BLOCK = 1 << 20
_SPACE_BYTE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in order, in lists of bounded size but for a word longer than that."""
    at = 0
    while at < len(text):
        cut = _SPACE_BYTE.search(text, at + WORD_BLOCK) if len(text) - at > WORD_BLOCK else None
        end = cut.start() if cut else len(text)
        # Without an argument, split knows of these six bytes of white space only.
        yield text[at:end].split()
        at = end


#: Keys of more rows than ``LEAST_HOT`` and than one in ``MOST_HOT`` of all are hot; there are at most ``MOST_HOT`` of them.
LEAST_HOT, MOST_HOT = 256, 4000


def spread_join(rows: DataFrame, counted: DataFrame, on: Sequence[str], total: int) -> DataFrame:
    """``rows`` joined with ``counted``, which holds each key once and in ``n`` how many of ``rows`` (of ``total``) have it.

    Hot keys, of which there are few by their definition, meet a broadcast
    where they lie; the others are shuffled, and none of those is large.
    """
    on, limit = list(on), max(LEAST_HOT, total // MOST_HOT)
    hot = counted.filter(F.col("n") > limit)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(counted.filter(F.col("n") <= limit), on))


def text_hash(text: str) -> Column:
    """A hash of a text column; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def one_of_each(df: DataFrame, roots: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row of each class of texts: of the smallest id (null last), of equal ids of the smallest text hash.

    ``roots`` gives (v, root) by text hash; texts that it lacks are classes of
    their own. Rows equal in id and text stay once, as the smallest of them;
    rows of equal id and different text are told apart.
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.col(id_col).isNull().alias("null"), text_hash(text).alias("v"))
    own = rows.groupBy("null", "id", "v").agg(F.count("*").alias("copies"))
    least = own.groupBy("v").agg(F.min(F.struct("null", "id", "copies")).alias("least"))
    least = least.join(roots.select("v", "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    chosen = least.groupBy("root").agg(F.min(F.struct("least.null", "least.id", "v", "least.copies")).alias("one"))
    chosen = chosen.select(F.col("one.id").alias("of_id"), F.col("one.v").alias("of_v"), F.col("one.copies").alias("copies"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("v") == F.col("of_v")))
    # Only rows that repeat are shuffled once more.
    again = kept.filter("copies > 1").groupBy("of_id", "of_v").agg(F.min("row").alias("row"))
    return kept.filter("copies = 1").select("row.*").unionByName(again.select("row.*"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["SPACE", "by_size", "found", "let", "one_of_each", "shared_dir", "spread_join", "staged", "table", "text_hash", "word_blocks", "words"]
