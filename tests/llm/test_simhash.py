import random

import pytest
import xxhash

from signalbase.llm import simhash
from signalbase.llm.simhash import components, fingerprint_of, keep_one, links, near_duplicates


def brute(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids_by_fp):
    """Smallest id reachable from each fingerprint, by comparing all."""
    fps = sorted(ids_by_fp)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for f in fps:
        least[find(f)] = min(least.get(find(f), 1 << 70), ids_by_fp[f])
    return {f: least[find(f)] for f in fps}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d", "ÄÖ x Y Z", "w " * 70_000])
def test_fingerprint(text):
    assert fingerprint_of(text) == brute(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limit", [1, 3, 64])
def test_links_and_components_against_brute_force(spark, limit):
    rnd = random.Random(limit)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(6):  # clusters, some of them dense
        centre = rnd.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum({1 << rnd.choice((3, 7, 30, 33, 40, 63, 12, 20)) for _ in range(rnd.randrange(5))}))
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = links(frame, limit)
    got = {frozenset(((r["a"] % (1 << 64)), (r["b"] % (1 << 64)))) for r in edges.collect()}
    true = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    assert got <= true
    roots = {r["v"] % (1 << 64): r["root"] % (1 << 64) for r in components(edges).collect()}
    wanted = classes({f: f for f in fps})
    groups = lambda m: {frozenset(x for x in fps if m.get(x, x) == v) for v in {m.get(x, x) for x in fps}}
    assert groups(roots) == groups(wanted)


def reached(edges):
    """The smallest vertex that each vertex of ``edges`` reaches."""
    least = {x: x for e in edges for x in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


@pytest.mark.parametrize("block", [3, 40, 1 << 19])
def test_components_of_edges_that_tasks_contract_by_blocks(spark, block):
    rnd = random.Random(block)
    edges = [tuple(rnd.sample(range(-150, 150), 2)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (500, 500), (1001, 1000)]
    edges += [(2000, k) for k in range(2001, 2050)]
    wanted = {v: r for v, r in reached(edges).items() if v != r}
    rows = components(spark.createDataFrame(edges, "a long, b long"), block).collect()
    assert len(rows) == len(wanted) and {r["v"]: r["root"] for r in rows} == wanted


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """The driver keeps the plans and stages of all rounds."""
    written = []
    keep = simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name: written.append(name) or keep(df, name))
    at = random.Random(9).sample(range(10**6), 3000)
    roots = components(spark.createDataFrame(list(zip(at, at[1:])), "a long, b long")).collect()
    assert {r["v"] for r in roots} == set(at) - {min(at)} and {r["root"] for r in roots} == {min(at)}
    assert len(roots) == 2999 and len(written) <= 3


def test_small_buckets_give_all_pairs(spark):
    fps = [1 << k for k in range(40)]
    edges = links(spark.createDataFrame([(f,) for f in fps], "fp long"), 64)
    assert edges.count() == 40 * 39 // 2


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, " "), (1003, "same TEXT here"), (1004, "Same text HERE"), (None, "same text here"), (1003, "same TEXT here")], "doc_id long, text string")
    rows = docs.unionByName(extra).collect()
    ids = {}
    for r in rows:
        f = brute(r["text"])
        ids[f] = min(ids.get(f, 1 << 60), r["doc_id"] if r["doc_id"] is not None else 1 << 60)
    wanted = classes(ids)
    got = near_duplicates(docs.unionByName(extra)).collect()
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), f"{brute(r['text']):016x}", wanted[brute(r["text"])]) for r in rows)
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["fingerprint"], r["component_id"]) for r in got) == texts
    kept = keep_one(docs.unionByName(extra)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(wanted.values()))


def test_one_id_on_two_texts_and_null_ids(spark):
    a, b, c = "alpha beta gamma delta", "some quite different text, of other words", "and a third one that is like neither of the two"
    rows = [(1, a), (1, b), (1, b), (2, a), (None, b), (None, c), (None, c)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, a), (1, b), (None, c)], key=repr)


def test_a_hot_vertex_is_split(spark):
    from signalbase.llm.common import LEAST_HOT, spread_join

    n = 4 * LEAST_HOT
    edges = spark.createDataFrame([(0, k) for k in range(1, n)] + [(n - 1, n), (n + 1, n + 2)], "a long, b long")
    roots = {r["v"]: r["root"] for r in components(edges).collect()}
    assert roots == {**{k: 0 for k in range(1, n + 1)}, n + 2: n + 1}
    rows = edges.groupBy("a").count().withColumnRenamed("count", "n")
    assert spread_join(edges, rows, ["a"], n + 1).count() == n + 1


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string, fp long")).count() == 0
