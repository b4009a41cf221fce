import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from signalbase.llm.packing import Capacities, WordTokenizer, best_fit, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a\n \nb", "a \n b", "a\t b", "a \tb", "x  y", "don't we'll", "a<|endoftext|>b", "über 123 456,7", "\U0001f600 \U0001f600", "\n\n x\n", "a " * 40, "é è\r\n ç", "a　 　b", "\x1c a", "tail \n"]


def test_words_encode_as_the_whole(plain):
    encoder, rnd = WordTokenizer(PATH, cache_words=20), random.Random(0)
    texts = HARD + ["".join(rnd.choice(["a", "b", " ", " ", "\n", "\t", "ß", "1", ".", "'s", " "]) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_capacities_find_the_tightest():
    rnd = random.Random(1)
    tree, plain_list = Capacities(100), []
    for k in range(3000):
        if rnd.random() < 0.6:
            room = rnd.randrange(1, 101)
            tree.add(room, k)
            plain_list.append(room)
        else:
            least = rnd.randrange(1, 101)
            fit = min((r for r in plain_list if r >= least), default=None)
            got = tree.take(least)
            assert (got and got[0]) == fit
            if fit:
                plain_list.remove(fit)


def test_best_fit_never_overfills():
    rnd = random.Random(2)
    lengths = np.array([rnd.randrange(1, 2048) for _ in range(5000)])
    at, room = best_fit(lengths)
    used = np.bincount(at, lengths)
    assert used.max() <= 2048 and (2048 - used).tolist() == room and sum(room) < 0.01 * 2048 * len(room)


def test_every_id_lies_in_one_piece(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6, None, 1), (10**6 + 1, "", 2), (10**6 + 2, "word " * 9000, 3), (10**6 + 3, "a", 4), (10**6 + 4, "a", 5)], "doc_id long, text string, length long")
    every = docs.unionByName(extra, allowMissingColumns=True)
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in every.collect()}
    pieces = {}
    windows = {}
    for r in pack(every, PATH, group_pieces=50).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded_length"]))
    assert set(pieces) == set(ids)
    for d, parts in pieces.items():
        at = 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(np.array(ids[d][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[d])
    for parts in windows.values():
        at = 0
        for offset, length, padded in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and padded == (at if at & (at - 1) == 0 else 2048)


def test_null_ids_and_empty_table(spark):
    assert pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), PATH).first()["doc_id"] is None
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
