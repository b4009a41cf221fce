import re
from collections import Counter

from pyspark.sql import functions as F

from signalbase.llm.divergence import ORACLE, divergence, share, term_vectors
from tests.compare import both

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(docs):
    """Every pair and term by exact integers, no vector and no baseline."""
    docs = [(t or "", x or "", s or "") for t, x, s in docs]
    out = set()
    for lang in {x for _, x, _ in docs}:
        own = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER)), s) for t, x, s in docs if x == lang]
        seen = Counter(term for terms, _ in own for term in set(terms))
        kept = {t for t, n in seen.items() if n >= 3}
        count = {s: Counter() for _, s in own}
        for terms, s in own:
            count[s].update(t for t in terms if t in kept)
        every = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 1) // (c.total() + len(kept))

        def ranked(s, part, values):
            for k, (v, item) in enumerate(sorted(((-v, i) for i, v in values.items()), key=lambda x: (x[0], x[1].encode()))):
                if part == "pair" or k < 200:
                    out.add((lang, s, part, item, -v, k + 1))

        for s in count:
            ranked(s, "pair", {o: sum((p(count[s], t) - p(count[o], t)) ** 2 // p(count[o], t) for t in kept) for o in count if o != s})
            ranked(s, "term", {t: (p(count[s], t) - p(every, t)) ** 2 // p(every, t) for t in kept if count[s][t] and p(count[s], t) > p(every, t)})
    return out


def rows_of(frame):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def check(spark, docs):
    frame = spark.createDataFrame([(k, *d, "x", 1) for k, d in enumerate(docs)], SCHEMA)
    assert rows_of(divergence(frame)) == brute(docs)


def test_against_exact_integers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(divergence(docs)) == brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()])


def test_nulls_repeats_ties_and_groups_without_terms(spark):
    docs = [("Tie tie, ALSO also\x00Äh äh", "en", "a")] * 3 + [("tie", "en", None)] * 2 + [("", "en", "bare"), (None, "en", "none"), ("12 34", "en", "digits")]
    docs += [("once only", "fr", "x"), ("twice only", "fr", "y"), (None, None, None), ("a b c", None, "s"), ("b", "", "s"), ("B b", "", "t"), ("solo", "it", "one")]
    check(spark, docs)
    ranks = [r for r in rows_of(divergence(spark.createDataFrame([(k, *d, "x", 1) for k, d in enumerate(docs)], SCHEMA))) if r[0] == "fr"]
    assert sorted(ranks) == [("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)]


def test_more_than_the_ranks_kept_and_a_long_text(spark):
    terms = [a + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwx"]
    docs = [(" ".join(terms[:300]), "en", "a")] * 3 + [(" ".join(terms), "en", "b")] + [((" ".join(terms) + "; ") * 900, "en", "c")]
    check(spark, docs)


def test_no_rows(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_64_bits(spark):
    counts = [0, 8_999_999_999, 9_000_000_000, 10**15, 10**18]
    frame = spark.createDataFrame([(c, 3 * 10**18, 7) for c in counts], "c long, n long, v long")
    got = [r[0] for r in frame.select(share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 1_000_000_000 * (c + 1) // (3 * 10**18 + 7) for c in counts]


def test_vectors_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    form = lambda df: {(r["lang"], r["term"], tuple(sorted(map(tuple, r["counts"])))) for r in term_vectors(df).collect()}
    assert form(docs) == form(docs.repartition(13))


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    ours, theirs = both(divergence(spark.read.parquet(f"{folder}/documents.parquet")), ORACLE, folder)
    assert ours == theirs
