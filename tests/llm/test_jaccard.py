import random

import pytest

import corpus_pipeline
from signalbase.llm import jaccard, simhash


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """Rows kept, by comparing all texts."""
    sets = {t: sets_of(t) for _, t in rows}
    left, kept = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)), []
    while left:
        first = left.pop(0)
        front = [first]
        while front:
            a = sets[front.pop()[1]]
            near = [r for r in left if 10 * len(a & sets[r[1]]) >= 8 * len(a | sets[r[1]])]
            front += near
            left = [r for r in left if r not in near]
        kept.append(first)
    return sorted(kept, key=repr)


def copies(n, words, seed):
    """``n`` copies of a text with up to three of their words changed."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randrange(1, 4)):
            w[rnd.randrange(words)] = f"x{k}_{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [7, 128])
def test_stage_against_brute_force(spark, block):
    texts = copies(60, 90, 1) + copies(20, 200, 2) + copies(5, 12, 3) + ["a b", "A  b", "a c", "clean text " * 40]
    random.Random(4).shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wanted = brute(rows)
    assert 4 < len(wanted) < 60
    assert sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(frame, block=block).collect()), key=repr) == wanted
    if block == 128:
        assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame, "").collect()), key=repr) == wanted


def test_classes_of_fingerprints_propose_without_any_band(spark, monkeypatch):
    """Copies within two bits of 64 are linked by SimHash alone; those further apart are not."""
    rows, near = [], set()
    for seed in range(12):
        pair = copies(1, 400, 100 + seed)
        v = [simhash.packed(simhash.bit_sums(jaccard.shingles(t)), len(jaccard.shingles(t))) for t in pair]
        if (v[0] ^ v[1]).bit_count() <= simhash.MAX_DISTANCE:
            near.add(2 * seed + 1)
        rows += [(2 * seed + k, t) for k, t in enumerate(pair)]
    assert 1 < len(near) < 12
    # One text in two letter cases has one fingerprint.
    rows += [(24, rows[0][1].upper()), (25, "a b c d e f"), (26, "A b c d e f")]
    monkeypatch.setattr(jaccard, "BANDS", 0)
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == set(range(27)) - near - {24, 26}


def unlike(n, opening, own, seed):
    """``n`` texts with an opening in common and words of their own, and a copy of every tenth with one word changed."""
    rnd = random.Random(seed)
    start = [f"o{k}" for k in range(opening)]
    out = []
    for k in range(n):
        w = start + [f"u{seed}_{k}_{rnd.randrange(10**6)}" for _ in range(own)]
        out.append(" ".join(w))
        if k % 10 == 0:
            w[rnd.randrange(opening, opening + own)] = "changed"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("weight", [1 << 21, 600])
def test_buckets_of_more_than_a_block_against_brute_force(spark, weight):
    """An opening that unlike texts share fills their minhashes, so blocks of few texts or shingles do not hold a bucket."""
    texts = unlike(90, 60, 40, 1) + unlike(60, 85, 16, 2) + unlike(40, 95, 8, 3) + copies(30, 90, 4) + ["o0 o1 o2 o3 o4 o5"]
    random.Random(5).shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.keep_one(frame, block=8 if weight > 600 else 128, weight=weight).collect()
    wanted = brute(rows)
    assert 100 < len(wanted) < 200
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == wanted


def test_prefixes_hold_a_shared_shingle_of_every_similar_pair(spark):
    rnd = random.Random(6)
    sets = []
    for _ in range(150):
        s = set(rnd.sample(range(40), 30)) if not sets or rnd.random() < 0.3 else set(rnd.choice(sets))
        sets.append(frozenset(s ^ set(rnd.sample(range(40), rnd.randrange(6)))))
    frame = spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "v long, s array<long>")
    short, long = {}, {}
    for r in jaccard.prefixes(frame).collect():
        long.setdefault(r["v"], set()).add(r["key"])
        if r["short"]:
            short.setdefault(r["v"], set()).add(r["key"])
    similar = 0
    for a in range(len(sets)):
        for b in range(len(sets)):
            if a != b and len(sets[a]) <= len(sets[b]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                similar += 1
                assert short.get(a, set()) & long.get(b, set())
    assert similar > 100
    assert sum(map(len, short.values())) < sum(map(len, long.values())) < sum(map(len, sets))


def test_an_opening_of_many_unlike_texts_gives_no_pairs_to_compare(spark, monkeypatch):
    """Work in proportion: the texts that blocks hold, all of them together."""
    held = []
    compared = jaccard._compared

    def counted(cut, sets, name):
        held.append(cut.count())
        return compared(cut, sets, name)

    monkeypatch.setattr(jaccard, "_compared", counted)
    work = []
    for n in (1000, 4000):
        frame = spark.createDataFrame([(k, t) for k, t in enumerate(unlike(n, 60, 40, 7))], "doc_id long, text string")
        held.clear()
        jaccard.links(frame, block=16).count()
        work.append(sum(held))
    assert work[1] < 6 * work[0] and work[1] < 20 * 4000


def test_names_that_clash_and_very_long_texts(spark):
    long = copies(1, 200_000, 8)
    rows = [(k, t, "mine", True, 7, "r") for k, t in enumerate([*long, "a b c d e f", "a b c d e f"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _v string, null boolean, root int, `row` string")
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_one_id_on_two_texts_and_null_ids(spark):
    a, b, c = copies(0, 50, 5)[0], copies(0, 50, 6)[0], copies(0, 50, 7)[0]
    rows = [(1, a), (1, b), (1, b), (2, a), (None, b), (None, c), (None, c), (None, None), (None, " ")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], (r["text"] or "").strip()) for r in kept), key=repr) == sorted([(1, a), (1, b), (None, c), (None, "")], key=repr)


def test_exactly_at_the_threshold():
    base = list(range(100))
    of = lambda *x: jaccard.np.array(x, jaccard.np.int64)
    assert jaccard.similar([of(*base[:80]), of(*base)])[0, 1] and not jaccard.similar([of(*base[:79]), of(*base)])[0, 1]


def test_empty_table(spark):
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
