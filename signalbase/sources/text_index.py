"""A sidecar of a store: which three-letter grams each of its files holds, so that a text search reads only files that may match.

For each file there are bitmaps of the hashes of all grams of all its records'
searched text. A needle may stand in a file only if the file has all grams of the
needle; the search itself then runs over those files and decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase.operators.search import haystack
from signalbase.operators.term_index import GRAM

#: Hash values of a file's bitmaps, which take an eighth of as many bytes at most.
HASHES = 1 << 18


def _hash(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(HASHES))


#: Characters of which grams are taken at a time.
PIECE = 1 << 20
#: Stands between two texts; no character has this number.
_BETWEEN = 0x110000


def _file_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, gram): the distinct grams of each run of rows (file, text) of one file."""
    plain, other, own = np.zeros(1 << 7 * GRAM, bool), set(), None

    def add(texts: list[str]) -> None:
        mark = _BETWEEN.to_bytes(4, "little")
        c = np.frombuffer(mark.join(t.encode("utf-32-le", "surrogatepass") for t in texts), "<u4").astype(np.int64)
        for at in range(0, len(c), PIECE):
            piece = c[at : at + PIECE + GRAM - 1]
            runs = [piece[k : len(piece) - GRAM + 1 + k] for k in range(GRAM)]
            if len(piece) < GRAM:
                continue
            most = np.maximum.reduce(runs)
            short, long = most < 128, (most >= 128) & (most < _BETWEEN)
            plain[sum(r[short] << 7 * (GRAM - 1 - k) for k, r in enumerate(runs))] = True
            other.update(np.unique(sum(r[long] << 21 * (GRAM - 1 - k) for k, r in enumerate(runs))).tolist())

    def done() -> Iterator[pa.RecordBatch]:
        for bits, packed in ((7, np.flatnonzero(plain)), (21, np.array(sorted(other), np.int64))):
            c = np.stack([packed >> bits * (GRAM - 1 - k) & (1 << bits) - 1 for k in range(GRAM)], axis=1).astype("<u4")
            text = c.tobytes().decode("utf-32-le", "surrogatepass")
            found = [text[k : k + GRAM] for k in range(0, len(text), GRAM)]
            yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.string()), pa.array(found, pa.string())], ["file", "gram"])
        plain[:] = False
        other.clear()

    for batch in batches:
        files, todo, size = batch.column(0).to_pylist(), [], 0
        for file, text in zip(files, batch.column(1)):
            if file != own:
                add(todo)
                todo, size = [], 0
                if own is not None:
                    yield from done()
                own = file
            todo.append(text.as_py() or "")
            size += len(todo[-1])
            if size >= PIECE:
                add(todo)
                todo, size = [], 0
        add(todo)
    if own is not None:
        yield from done()


def build_index(rows: DataFrame) -> DataFrame:
    """(file, bucket, bits) of records read from files.

    Distinct grams are gathered where the records lie, so what travels is at
    most one row a file part and hash value.
    """
    texts = rows.select(F.col("_metadata.file_path").alias("file"), haystack().alias("text"))
    seen = texts.mapInArrow(_file_grams, "file string, gram string").select("file", _hash(F.col("gram")).alias("h")).distinct()
    return seen.groupBy("file", F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))


def files_that_may_hold(spark: SparkSession, index: DataFrame, needle: str) -> list[str] | None:
    """Paths of the files that have all grams of a lower-cased needle; None where it is too short to tell."""
    if len(needle) < GRAM:
        return None
    # Cut by characters, as the files' texts are; a regular expression also begins between the halves of one.
    own = sorted({needle[k : k + GRAM] for k in range(len(needle) - GRAM + 1)})
    wanted = spark.range(1).select(F.explode(F.array_distinct(F.array(*(_hash(F.lit(g)) for g in own)))).alias("h"))
    # The grams of one needle: as many rows as it has letters.
    wanted = wanted.select(F.bitmap_bucket_number("h").alias("bucket"), F.bitmap_bit_position("h").alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))) != 0
    met = index.join(F.broadcast(wanted), "bucket").filter(here).groupBy("file").agg(F.count("*").alias("n"))
    return [r["file"] for r in met.join(wanted.agg(F.count("*").alias("n")), "n").select("file").collect()]
