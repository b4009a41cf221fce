import re
from itertools import permutations

from signalbase.llm.audit import ORACLE, audit, cells, masks, parity_sums
from tests.compare import both

DOCS = "doc_id long, text string, lang string, key string, mask string"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    """The contract's counts by applying the filters one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any((t or "") == text and j is not None and j < i for j, t, _ in docs),
        }
        rows.append((lang or "", {f for f in failed if failed[f]}, i in good, i in toxic))
    orders = ["".join(o) for o in permutations("ABCDE")]
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in orders:
            left = own
            for k, f in enumerate(order):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
                failing = [r for r in own if f in r[1]]
                out[part, order, k + 1] = (len(left), len(removed), len(failing) - len(removed), sum(r[1] == {f} for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed))
    return {key: value + (shapley[key[0], key[1][key[2] - 1]],) for key, value in out.items()}


def rows_of(frame):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in frame.collect()}
    assert len(got) == frame.count()
    return got


def check(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    marks = spark.createDataFrame([(*x, "z") for x in labels], LABELS)
    assert rows_of(audit(frame, marks)) == brute(docs, labels)


def test_against_one_filter_after_the_other(spark):
    many = " ".join(f"w{k}" for k in range(120))
    same = " ".join(["again"] * 130)
    shout = " ".join(f"LOUD{k}" for k in range(120))
    texts = [many, same, shout, many + " $", same + " |", shout + " #", "short", "SHORT", "short %", None, "", "äö 世界", many + "\x0b" + many]
    docs = [(k, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts * 2)]
    docs += [(3, many, "en"), (3, many, "en"), (None, many, "en"), (None, many, "de"), (None, None, None), (90, "only", "fr"), (91, many + "\x00" + "\U0001f600" * 3, "fr")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (3, 1, None), (13, 1, 1), (None, 1, 1), (5000, 1, 1), (90, 0, 1), (90, 1, 0)]
    check(spark, docs, labels)
    check(spark, docs, [])


def test_long_text_and_copies_over_parts(spark):
    long = " ".join(f"word{k % 70000}" for k in range(400_000)) + " " + "x" * 2_000_000
    check(spark, [(7, long, "en"), (4, long, "de"), (4, long, "en"), (9, long, "de")], [(4, 1, 1), (9, 1, 0)])


def test_empty_tables(spark):
    assert audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_the_transform_inverts_exactly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = masks(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    wanted = {}
    for r in counts.collect():
        wanted.setdefault(r["part"], [0] * 32)[r["mask"]] += r["n"]
    assert {r["part"]: r["every"] for r in cells(parity_sums(counts)).collect()} == wanted


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    ours, theirs = both(audit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")), ORACLE, folder)
    assert ours == theirs and len(ours) % 600 == 0
