import hashlib
import re

from signalbase.llm.mixing import mix, taken_rows


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    capped = set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * total[s] if s in capped else weight[s] * level for s in sources}
    out = {}
    for s in sources:
        key = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        before, goal = 0, round(target[s])
        for r in sorted((r for r in rows if r[2] == s), key=key):
            n = size(r[1])
            k = goal // total[s] if total[s] else 0
            out.setdefault(r[0], []).append((n, total[s], target[s], k * n + max(0, min(n, goal - k * total[s] - before))))
            before += n
    return out


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    extra = spark.createDataFrame([(10**6, None, "src0", 1), (10**6 + 1, "", None, 2), (10**6 + 2, "a b c", None, 3), (10**6 + 3, "x", "zz", 4)], "doc_id long, text string, source string, size long")
    every = docs.unionByName(extra, allowMissingColumns=True)
    wanted = brute([(r["doc_id"], r["text"], r["source"]) for r in every.collect()])
    got = mix(every).collect()
    assert len(got) == every.count()
    for r in got:
        (n, total, target, taken), = wanted[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (n, total, taken) and abs(r["target"] - target) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        assert r["position"] is None or 0 <= r["position"] <= 1
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 1 for taken, target in by_source.values())
    again = {r["doc_id"]: r["taken"] for r in mix(every.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d", "s", "x")] * 5 + [(None, "e f", None, "y")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, text_hash string")
    got = mix(frame)
    assert got.count() == 8
    out = taken_rows(frame)
    assert out.columns == frame.columns and out.count() >= 5
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).count() == 0 and taken_rows(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix(blank).collect()] == [0, 0]


def test_rows_come_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    positions = [r["position"] for r in mix(docs).collect() if r["position"] is not None]
    assert positions == sorted(positions)


def test_columns_of_the_caller_stay(spark):
    rows = [(1, "a b c d", "s", "mine", 5, "of", "h")] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, _position int, _of string, _hash string")
    out = taken_rows(frame)
    assert out.columns == frame.columns and {tuple(r) for r in out.collect()} == set(rows)
