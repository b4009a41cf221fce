import pytest

import corpus_pipeline
from signalbase.llm import mixing, quality
from tests.llm.test_jaccard import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's rows over the stage before it."""
    out, docs = [], spark.read.parquet(f"{SMALL}/documents.parquet")
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, SMALL), "test-stage")
        out.append(docs)
    return out


def test_columns(stages):
    for frame in stages[1:-1]:
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS


def test_quality_keeps_what_the_rules_keep(stages):
    kept = {r["doc_id"] for r in quality.quality_rules(stages[0]).filter("kept").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == kept and len(kept) > 100


def test_one_of_each_class_stays(stages):
    """Five-word shingles at a similarity of 0.8, as the stage's contract has it, by comparing all texts."""
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert sorted(((r["doc_id"], r["text"]) for r in stages[2].collect()), key=repr) == brute(rows)


def test_secrets_are_masked(stages):
    before, after = ({r["doc_id"]: r["text"] for r in stages[k].collect()} for k in (2, 3))
    assert before.keys() == after.keys()
    for i, text in before.items():
        assert (text == after[i]) == ('token = "' not in text and "password=" not in text)
        assert 'token = "' not in after[i] or "[SECRET]" in after[i]


def test_mix_takes_what_it_says(stages):
    wanted = {}
    for r in mixing.mix(stages[3]).collect():
        if n := int(r["taken"] / r["size"] + 0.5) if r["size"] else 0:
            wanted[r["doc_id"]] = n
    got = {}
    for r in stages[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == wanted


def test_packing_holds_every_document(stages):
    pieces = stages[5].collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in stages[4].collect()}
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_run(spark, stages):
    key = lambda f: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in f.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(stages[5])
