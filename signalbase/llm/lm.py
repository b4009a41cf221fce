"""Log-likelihood of documents under a gated recurrent language model that is trained on the corpus itself.

Tokens are words in lower case (A-Z only) and one end a text. Counts of all tokens
of all training documents give the base score; they also give the model its
classes, its starting point and the words' probabilities within the classes of
rarer words. The recurrent network (``gru.py``) is then trained once through all
training documents: replicas take their partitions' documents, and Spark averages
their parameters by blocks, in rounds that grow. Scoring carries the state through
a document of any length.

Sizes that do not grow with the corpus are parameters of the model: ``HEAD`` words
with a softmax of their own, ``SUFFIXES`` classes of the other words (by their last
two bytes), the network's parameters (about 0.3 MB, the only thing gathered on the
driver beside ``DICTIONARY`` words and their counts). The dictionary spares frequent
words a join and changes no result; all other words meet their counts in a
shuffled join.

Defined results: a null text counts as empty and is one end token; a null id as the
text ''. A word that training has not seen has count 0 in the base score and, in the
model, a share of its class as of half an occurrence. Without training documents
every token has the base probability 1. Rows that repeat each count and are each
scored. Other columns are not read, whatever their names. No rows give no rows. Texts
are cut into words by blocks, so a text of any length takes 2 bytes a token beside
itself. Scores of equal texts may differ by rounding (32 bits) between batches.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbase.llm import gru
from signalbase.llm.common import by_size, staged, word_blocks

HEAD, CLASSES, SUFFIXES, DICTIONARY = 1024, 16, 64, 131_072
#: Sixteenths of the training documents at which a round ends, and tokens that a replica sees at least, where there are as many.
ROUNDS, REPLICA_TOKENS = (1, 2, 4, 8, 16), 1 << 20
#: Tokens that are trained or scored side by side, entries of a task's counts, floats of a parameter block, replicas averaged at a time.
TRAINED, SCORED, COUNTED, BLOCK, LOT = 1 << 19, 1 << 21, 500_000, 1 << 15, 64
HELD_OUT = (5, 1)


def held_out(id_col: str) -> Column:
    """Whether a document is kept from training, by the checksum of its id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


@dataclass
class Vocabulary:
    """What the corpus counts leave on the driver: sums, and the words of the dictionary in order of frequency, the end first."""

    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    head: int
    #: Counts smoothed by a half and summed by class of the rarer words.
    tail: np.ndarray

    def network(self, vector: np.ndarray | None = None) -> gru.Network:
        counts = np.maximum(self.counts[: self.head], 1).astype(np.float64)
        return gru.Network(counts, self.tail, gru.class_starts(counts, min(CLASSES, self.head)), vector)

    @property
    def base_shift(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        words = pa.array(list(counts), pa.binary())
        classes = pa.array([suffix_class(w) for w in counts], pa.int32())
        whole = pa.RecordBatch.from_arrays([words, classes, pa.array(counts.values(), pa.int64())], names=["word", "tail", "n"])
        return (whole.slice(at, 10_000) for at in range(0, whole.num_rows, 10_000))

    for batch in by_size(batches):
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            for block in word_blocks(text.lower()):
                counts.update(block)
        # The end is the empty word.
        counts[b""] += batch.num_rows
        if len(counts) > COUNTED:
            yield from rows()
            counts.clear()
    yield from rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(word, tail, n): how often each word, and the end as the empty word, occurs in the training documents."""
    texts = docs.filter(~held_out(id_col)).select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(_count, "word binary, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The dictionary is bounded by a threshold on counts, found from their histogram by 64ths of powers of two."""
    level = F.floor(F.log2("n") * 64)
    histogram = dict(counts.groupBy(level.alias("level")).agg(F.count("*")).collect())
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, room = None, DICTIONARY
    for key in sorted(histogram, reverse=True):
        room -= histogram[key]
        if room < 0:
            break
        least = key
    frequent = F.lit(False) if least is None else level >= F.lit(least)
    known = {bytes(r["word"]): r["n"] for r in counts.filter(frequent | (F.octet_length("word") == 0)).select("word", "n").collect()}
    words = sorted(known, key=lambda w: (w != b"", -known[w], w)) or [b""]
    numbers = np.array([known.get(w, 0) for w in words], np.int64)
    head = min(HEAD, len(words))
    mass, kinds = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in counts.filter(F.octet_length("word") > 0).groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        mass[r["tail"]], kinds[r["tail"]] = r["n"], r["k"]
    for word, n in zip(words[1:head], numbers[1:head]):
        mass[suffix_class(word)] -= n
        kinds[suffix_class(word)] -= 1
    return Vocabulary(total, distinct, words, numbers, head, mass + 0.5 * (kinds + 1))


_REST = pa.struct([("word", pa.binary()), ("n", pa.int64())])


class _Numbers(dict):
    """Numbers of the dictionary's words; another word gives -1 less its class, and is noted."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, k) for k, w in enumerate(words))
        self.others: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.others.append(word)
        return -1 - suffix_class(word)


def _encoder(shared, names: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        numbers = _Numbers(v.words)
        logs = np.log10(v.counts + 0.5)
        log_tail = np.log10(v.tail)
        # The network's token of each word of the dictionary, and what its class adds to that token's probability.
        tokens = np.array([k if k < v.head else v.head + suffix_class(w) for k, w in enumerate(v.words)], np.uint16)
        within = np.where(np.arange(len(tokens)) < v.head, 0.0, logs - log_tail[np.maximum(tokens.astype(np.int64) - v.head, 0)])

        def one(text: bytes) -> tuple:
            parts, base, tail, known, rest = [], 0.0, 0.0, 0, Counter()
            for block in word_blocks(text.lower()):
                at = np.fromiter(map(numbers.__getitem__, block), np.int64, len(block))
                other = at < 0
                found, kinds = at[~other], -1 - at[other]
                ids = np.empty(len(at), np.uint16)
                ids[~other], ids[other] = tokens[found], v.head + kinds
                base += float(logs[found].sum())
                tail += float(within[found].sum()) - float(log_tail[kinds].sum())
                known += len(found)
                rest.update(numbers.others)
                numbers.others.clear()
                parts.append(ids)
            parts.append(np.zeros(1, np.uint16))
            ids = np.concatenate(parts)
            return ids.tobytes(), len(ids), known + (v.counts[0] > 0), base + logs[0], tail, rest

        for batch in by_size(batches):
            made = [one(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            offsets = np.cumsum([0] + [len(m[5]) for m in made])
            flat = [pa.array([w for m in made for w in m[5]], pa.binary()), pa.array([n for m in made for n in m[5].values()], pa.int64())]
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(_REST)))
            columns = [pa.array([m[0] for m in made], pa.large_binary() if sum(len(m[0]) for m in made) >> 31 else pa.binary())]
            columns += [pa.array([m[k] for m in made], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns, rest], names=names)

    return encode


def encode(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """Each document as the network's tokens, with its dictionary words' part of the scores and its other words counted."""
    texts = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kinds = "held_out boolean, ids binary, n_tokens long, n_known long, base double, tail double, rest array<struct<word:binary,n:long>>"
    schema = T.StructType([texts.schema["doc_id"], *T.StructType.fromDDL(kinds)])
    shared = docs.sparkSession.sparkContext.broadcast(v)
    rows = texts.mapInArrow(_encoder(shared, schema.fieldNames()), schema)
    return staged(rows.withColumn("row_id", F.monotonically_increasing_id()), "lm-tokens")


def _chunks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches with their documents' tokens, gathered until they hold ``tokens``."""
    kept, texts, held = [], [], 0
    for batch in by_size(batches):
        ids = [np.frombuffer(b, np.uint16) for b in batch.column("ids").to_pylist()]
        kept.append(batch.drop_columns(["ids"]))
        texts += ids
        held += sum(map(len, ids))
        if held >= tokens:
            yield kept, texts
            kept, texts, held = [], [], 0
    if kept:
        yield kept, texts


def _blocks(vector: np.ndarray, lot: int, weight: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(vector), BLOCK):
        one = [pa.array([at // BLOCK], pa.int32()), pa.array([lot], pa.int32()), pa.array([weight], pa.int64()), pa.array([vector[at : at + BLOCK].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(one, names=["block", "lot", "weight", "floats"])


_BLOCK = "block int, lot int, weight long, floats binary"


def _trainer(shared):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, vector = shared.value
        net, seen = v.network(vector.copy()), 0
        for _, texts in _chunks(batches, TRAINED):
            stream = np.concatenate(texts).astype(np.int64)
            net.train(stream)
            seen += len(stream)
        if seen:
            yield from _blocks(net.vector, TaskContext.get().partitionId() % LOT, seen)

    return train


def _average(table: pa.Table) -> pa.Table:
    total, mean = 0, 0.0
    for weight, floats in zip(table.column("weight").to_pylist(), table.column("floats").to_pylist()):
        total += weight
        mean = mean + (np.frombuffer(floats, np.float32) - mean) * (weight / total)
    return pa.table({"block": table.column("block")[:1], "lot": pa.array([0], pa.int32()), "weight": pa.array([total], pa.int64()), "floats": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})


def train(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    """The network's parameters after one pass over all training documents.

    In a round each partition trains a replica on its documents of that round, and
    the replicas' parameters are averaged, weighted by tokens, first by lots.
    """
    spark = encoded.sparkSession
    vector = v.network().vector
    if not v.tokens:
        return vector
    part = F.pmod(F.xxhash64("row_id"), F.lit(ROUNDS[-1]))
    for first, last in zip((0, *ROUNDS), ROUNDS):
        rows = encoded.filter(~F.col("held_out") & (part >= first) & (part < last)).select("ids")
        replicas = max(1, v.tokens * (last - first) // ROUNDS[-1] // REPLICA_TOKENS)
        shared = spark.sparkContext.broadcast((v, vector))
        trained = rows.coalesce(replicas).mapInArrow(_trainer(shared), _BLOCK)
        for by in (["block", "lot"], ["block"]):
            trained = trained.groupBy(*by).applyInArrow(_average, _BLOCK)
        blocks = {r["block"]: np.frombuffer(r["floats"], np.float32) for r in trained.collect()}
        if blocks:
            vector = np.concatenate([blocks[k] for k in sorted(blocks)])
    return vector


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, vector = shared.value
        net = v.network(vector.copy())
        for kept, texts in _chunks(batches, SCORED):
            logs, at = net.score(texts) / math.log(10), 0
            for batch in kept:
                yield batch.append_column("network", pa.array(logs[at : at + batch.num_rows], pa.float64()))
                at += batch.num_rows

    return score


def score(encoded: DataFrame, counts: DataFrame, v: Vocabulary, vector: np.ndarray) -> DataFrame:
    """The contract's columns, one row a document."""
    shared = encoded.sparkSession.sparkContext.broadcast((v, vector))
    scalars = ("row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail")
    rows = encoded.select(*scalars, "ids")
    schema = T.StructType([*(rows.schema[c] for c in scalars), T.StructField("network", T.DoubleType())])
    scored = rows.mapInArrow(_scorer(shared), schema)

    rest = encoded.select("row_id", F.explode("rest").alias("r")).select("row_id", "r.word", F.col("r.n").alias("times"))
    # Words of the dictionary are no rest, so their counts need not travel.
    rare = counts.filter(F.octet_length("word") > 0).select("word", "n")
    if len(v.words) > 1:
        rare = rare.filter(F.col("n") <= F.lit(int(v.counts[-1])))
    met = rest.join(rare, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("row_id").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    both = scored.join(sums, "row_id", "left")
    more = F.coalesce("more", F.lit(0.0))
    trained = v.tokens > 0
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(v.base_shift)).alias("base_score"),
        (F.col("network") + F.col("tail") + more if trained else F.lit(0.0)).alias("score"),
    )


def log_likelihood(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, encodes, trains and scores ``docs`` (``id_col``, text)."""
    counts = staged(word_counts(docs, id_col), "lm-counts")
    v = vocabulary(counts)
    encoded = encode(docs, v, id_col)
    return score(encoded, counts, v, train(encoded, v))
