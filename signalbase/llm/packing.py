"""Packing documents into training sequences by best-fit decreasing.

A document's ids are cut into full windows first; each is a sequence of its
own. What is left of it, shorter than a window, is packed best-fit
decreasing: a segment tree over remaining capacities finds the tightest open
window for each piece. Tokenising runs where the rows are and yields pieces
without their ids, so only a few numbers a document are shuffled, dealt
evenly over groups of bounded size by the pieces' running numbers.

A sequence is padded to the full window, unless the length it has is a power
of two (``padded_length``). Best fit over a group of thousands of pieces
leaves under a tenth of a per cent of padding.

Defined cases: a null text counts as empty, and an empty text still has its
end id; repeated rows are packed each for itself; a null id is kept as null;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbase.llm.common import by_size, staged

WINDOW = 2048
END_ID = 1
#: Pieces shorter than a window that one packing group takes at most, on average.
GROUP_PIECES = 40_000
#: Distinct words whose ids a Python worker remembers at most.
CACHE_WORDS = 800_000


_PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))


def _ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level vocabulary file with their ids, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    special = {t["content"] for t in vocabulary["added_tokens"]}
    # Byte-level files write a byte as a printable character: itself where printable, else the next from U+0100 on.
    hidden = [b for b in range(256) if b not in _PRINTABLE]
    byte = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}


class WordTokenizer:
    """Ids of a byte-level BPE vocabulary file as little-endian unsigned 32-bit numbers.

    Such a vocabulary never merges across a space that text surrounds, so a
    text is encoded word by word and words are remembered; ``tiktoken`` does
    the words by the file's own ranks. Texts with special tokens, or with a
    space that white space or the text's end follows, are encoded whole by
    ``tokenizers``.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(path)
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = np.zeros(max(ranks.values()) + 1, bool)  # ids that begin with a space
        self.opens[[i for token, i in ranks.items() if token.startswith(b" ")]] = True
        self.cache_words, self.known = cache_words, {}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words as they stand after a space. Encoded in a row, each begins at an id with a space."""
        ids = np.array(self.words.encode_ordinary(" " + " ".join(words)), "<u4")
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):
            self.known.update((w, array("I", self.words.encode_ordinary(" " + w)).tobytes()) for w in words)
            return
        data, bounds = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
        for w, i, j in zip(words, bounds, bounds[1:]):
            self.known[w] = data[i:j]

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return array("I", self.words.encode_ordinary(first)).tobytes() + b"".join(map(self.known.__getitem__, rest))
        except KeyError:
            if len(self.known) > self.cache_words:
                self.known = {}
        missing = {w for w in rest if w not in self.known}
        if any(not w or w[0].isspace() for w in missing):  # never remembered, so every such text comes here
            return self.whole(text)
        for w in [w for w in missing if w[-1].isspace()]:  # in a row, what follows would change how its end is cut
            self.known[w] = array("I", self.words.encode_ordinary(" " + w)).tobytes()
            missing.remove(w)
        if missing:
            self.learn(list(missing))
        return array("I", self.words.encode_ordinary(first)).tobytes() + b"".join(map(self.known.__getitem__, rest))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Piece(NamedTuple):
    start: int
    length: int
    crc: int


def pieces_of(ids: bytes, window: int = WINDOW, at: int = 0) -> Iterator[Piece]:
    """Full windows of encoded ids, then the rest."""
    for i in range(0, len(ids), 4 * window):
        part = ids[i : i + 4 * window]
        yield Piece(at + i // 4, len(part) // 4, zlib.crc32(part))


def tokenized(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(piece_no, id, start, length, ids_crc32, doc_tokens): a row for each piece."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n, end = None, TaskContext.get().partitionId() << 33, array("I", [END_ID]).tobytes()
        for batch in by_size(batches):
            encoder = encoder or WordTokenizer(tokenizer_path)
            of, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                for p in pieces_of(ids, window):
                    rows.append((n, *p, len(ids) // 4))
                    of.append(k)
                    n += 1
            no, start, length, crc, total = (pa.array(x, pa.int64()) for x in zip(*rows))
            yield pa.RecordBatch.from_arrays([no, batch.column(0).take(pa.array(of, pa.int64())), start, length, crc, total], ["piece_no", "id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = f"piece_no bigint, id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


class Capacities:
    """Segment tree over capacities: how many open windows have each remaining capacity."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window_no: int) -> None:
        self.open[room].append(window_no)
        i = self.size + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The open window of the least capacity that is at least ``least``: (capacity, number)."""
        i = self.size + least
        if not self.count[i]:
            while True:  # up to the first ancestor whose right sibling holds one, then down and left
                if i == 1:
                    return None
                if not i & 1 and self.count[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        number = self.open[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, number


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, list[int]]:
    """Window number of each piece, and the room left in each window."""
    tree, room_of, at = Capacities(window), [], np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        length = int(lengths[k])
        room, number = tree.take(length) or (window, len(room_of))
        if number == len(room_of):
            room_of.append(window)
        at[k], room_of[number] = number, room - length
        if room > length:
            tree.add(room - length, number)
    return at, room_of


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length)."""
    pieces = staged(tokenized(df, tokenizer_path, id_col, text, window), "pieces")
    full = pieces.filter(F.col("length") == window)
    rest = pieces.filter(F.col("length") < window)
    groups = max(1, -(-rest.count() // group_pieces))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint"

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("piece_no")
        lengths = group.column("length").to_numpy()
        at, room_of = best_fit(lengths, window)
        order = np.argsort(at, kind="stable")
        group, at, lengths = group.take(pa.array(order)), at[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        first = np.searchsorted(at, at)  # each window's first piece
        used = window - np.array(room_of, np.int64)[at]
        padded = np.where(used & (used - 1), window, used)
        columns = [*(group.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")), pa.array((key[0].as_py() << 32) + at), pa.array(before - before[first]), pa.array(padded)]
        return pa.table(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    dealt = rest.withColumn("g", F.pmod(F.xxhash64("piece_no"), F.lit(groups)))
    short = dealt.groupBy("g").applyInArrow(packed, schema)
    # Full windows are sequences of their own; their numbers lie above those of all groups.
    own = full.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece_no") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("padded_length"))
    return own.unionAll(short).withColumnRenamed("id", id_col)
