import re

import pytest

from signalbase.llm.quality import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)} if len(w) < 3000 else None
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), covered if covered is None else len(covered)


def test_counts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for row in docs.collect():
        n, chars, symbols, dups, repeats = brute(row["text"])
        r = got[row["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dups)
        assert repeats is None or r["n_repeat_words"] == repeats
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)


EDGES = [None, "", " \n\t", "a", "a b", "a a a a", "a b c a b c", " x  y\x85z", "same line\n\nsame line\n same line", "a|b #c", "\U0001f600 " * 60, "word " * 200_000]


@pytest.mark.parametrize("k", range(len(EDGES)))
def test_edges(spark, k):
    frame = spark.createDataFrame([(1, EDGES[k], "x"), (1, EDGES[k], "x"), (None, EDGES[k], None)], "doc_id long, text string, n_words string")
    rows = quality_rules(frame).collect()
    assert len(rows) == 3 and len({r["n_repeat_words"] for r in rows}) == 1
    n, chars, symbols, dups, repeats = brute(EDGES[k])
    assert (rows[0]["n_words"], rows[0]["word_chars"], rows[0]["n_symbols"], rows[0]["n_dup_lines"]) == (n, chars, symbols, dups)
    assert rows[0]["n_repeat_words"] == (n if repeats is None else repeats)
    assert rows[0]["kept"] is False


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_verdicts_follow_the_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in bad) <= 0.02 * len(bad) and sum(r["kept"] for r in good) >= 0.98 * len(good)


def test_one_projection(spark):
    plan = quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
