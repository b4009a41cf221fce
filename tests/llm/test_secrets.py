import pytest

from signalbase.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_held_out_accuracy(spark, model):
    from pyspark.sql import functions as F

    held = secrets.labelled_findings(spark, 2 * secrets.LABELLED_ROWS).filter(F.col("doc_id") >= secrets.LABELLED_ROWS)
    scored = secrets.scan(held, model, path="path").join(held.select("doc_id", "label"), "doc_id")
    row = scored.agg(F.count("*").alias("n"), F.count_if(F.col("is_secret") == (F.col("label") == 1)).alias("good")).first()
    assert row["n"] >= 0.95 * secrets.LABELLED_ROWS and row["good"] >= 0.97 * row["n"]


FOUND = [
    (1, 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" then', True),
    (2, "and password=49b0203a9cc466e6ee in", True),
    (3, "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 of", False),
    (4, "password = example_password_1", False),
    (5, "card 4845168114407329 was", False),
]


def test_findings_and_places(spark, model):
    frame = spark.createDataFrame([(*r[:2], "src1") for r in FOUND] + [(6, None, None), (7, "", "x"), (None, FOUND[0][1], None), (8, "plain prose", "y")], "doc_id long, text string, source string")
    rows = secrets.scan(frame, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for i, text, verdict in FOUND:
        assert got[i]["is_secret"] is verdict, (i, got[i])
        assert text[got[i]["start"] : got[i]["end"]] in text.replace('"', " ").replace("=", " ").split()


def test_redact(spark, model):
    twice = FOUND[0][1] + " and \U0001f600 " + FOUND[1][1]
    rows = [(1, twice, "s", 0), (1, twice, "s", 0), (2, "clean text", "s", 1), (3, None, None, 2), (None, FOUND[1][1], "s", 3), (4, FOUND[2][1], "s", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, start long")
    out = secrets.redact(frame, model)
    assert out.columns == frame.columns
    got = sorted((r["start"], r["text"] or "") for r in out.collect())
    masked = 'set token = "[SECRET]" then and \U0001f600 and password=[SECRET] in'
    assert got == [(0, masked), (0, masked), (1, "clean text"), (2, ""), (3, "and password=[SECRET] in"), (4, FOUND[2][1])]


def test_empty_table_and_native_plan(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secrets.scan(empty, model).count() == 0 and secrets.redact(empty, model).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "Python" not in secrets.scan(docs, model)._jdf.queryExecution().executedPlan().toString()


#: Findings of shapes that the training rows do not have: (text, value, label).
def unseen():
    import hashlib
    import random
    import string

    rnd, rows = random.Random(11), []
    of = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    every, base36 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    for k in range(40):
        rows += [
            (f"slack posts with xoxb-{of(12, string.digits)}-{of(24, every)} as token", 1),
            (f"'oauth_secret': 'GOCSPX-{of(24, every)}', # note {k}", 1),
            (f"sshpass_pwd={of(16, base36)} run", 1),
            (f"mongodb+srv://svc:{of(18, every)}@cluster{k}.example.net", 1),
            (f'const apiKey = "AIza{of(33, every)}";', 1),
            (f"signing secret whsec_{of(30, every)} and so on", 1),
            (f"etag {hashlib.md5(str(k).encode()).hexdigest()} in the answer", 0),
            (f"the password: forgotten-again-{k} was a joke", 0),
            (f"isbn {of(13, string.digits)}{of(4, string.digits)} of the book", 0),
            (f"file report_2024_{k:02d}_final_version_{k}_for_printing.pdf was", 0),
            (f"tokens_total: {of(8, string.digits)} units", 0),
            (f"secret: see_the_manual_page_{k}", 0),
        ]
    return [(k, t, f"lib/part{k % 7}", y) for k, (t, y) in enumerate(rows)]


def test_shapes_that_training_has_not_seen(spark, model):
    rows = unseen()
    got = secrets.scan(spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string"), model).collect()
    says = {r[0]: False for r in rows}
    for r in got:
        says[r["doc_id"]] |= r["is_secret"]
    hit = sum(says[k] for k, *_, y in rows if y)
    wrong = sum(says[k] for k, *_, y in rows if not y)
    recall, precision = hit / sum(r[3] for r in rows), hit / max(1, hit + wrong)
    print(f"unseen shapes: recall {recall:.3f}, precision {precision:.3f}", {rows[k][1][:18]: sum(says[j] for j in range(k, len(rows), 12)) for k in range(12)})
    assert recall >= 0.8 and precision >= 0.8
    assigned = {(r["assigned"], r["is_secret"]) for r in got}
    assert len(assigned) == 4, "neither an assignment nor its absence decides"


def test_candidates_against_python(spark):
    """Places and features by a plain second way, over texts of one candidate."""
    texts = {
        'a token = "abc def ghi" z': ("abc def ghi", 1),
        "db_password=Hunter2! x": ("Hunter2!", 1),
        "x postgres://u:pa55wd@h/db y": ("pa55wd", 1),
        "jwt eyJ0eXAi.eyJzdWIi.c2lnbmF0dXJl end": ("eyJ0eXAi.eyJzdWIi.c2lnbmF0dXJl", 0),
        "(0123456789abcdef)": ("0123456789abcdef", 0),
        "'client-secret' => 'zz9'": ("zz9", 1),
        "short abc123 words": None,
        "password is hidden": None,
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'p' AS source")
    got = {r["id"]: r for r in secrets.candidates(frame, "doc_id", "text", "source").collect()}
    for k, (t, wanted) in enumerate(texts.items()):
        if wanted is None:
            assert k not in got
        else:
            r, (value, assigned) = got[k], wanted
            assert (r["value"], r["start"], r["end"], r["assigned"]) == (value, t.index(value), t.index(value) + len(value), bool(assigned))
            assert r["right1"] == (t[r["end"] :].split() or [""])[0]


LONG = ["token" * 200_000, "password" + " " * 500_000 + "x", "a1" * 300_000, "a1." * 200_000, 'password="' * 60_000, "://" * 200_000, "secret_" * 100_000 + "=" + "x" * 100_000]


def test_long_texts(spark):
    frame = spark.createDataFrame([(k, t, "s") for k, t in enumerate(LONG)], "doc_id long, text string, source string")
    assert secrets.candidates(frame, "doc_id", "text", "source").count() >= 3


def test_clashing_columns(spark, model):
    frame = spark.createDataFrame([(1, FOUND[1][1], "s", "k", 5, 6)], "doc_id long, text string, source string, _key string, _row long, _spans long")
    row = secrets.redact(frame, model).first().asDict()
    assert row == {"doc_id": 1, "text": "and password=[SECRET] in", "source": "s", "_key": "k", "_row": 5, "_spans": 6}


def test_labelled_rows_are_bounded_by_a_hash_sample(spark):
    findings = secrets.labelled_findings(spark, 3000)
    small = secrets.train(findings.orderBy("doc_id"), trees=3, depth=3, most=600)
    again = secrets.train(findings.orderBy("label"), trees=3, depth=3, most=600)
    assert small.transitions == again.transitions


def test_masks_in_texts_of_any_length(spark):
    """Blocks against a mask over the whole text, with spans at and across the edges of blocks, and very many spans."""
    size, mask = secrets.MASKED, secrets.MASK
    long = "aé\U0001f600" * size
    edges = [(0, 3), (size - 5, size), (size, size + 4), (2 * size - 3, 2 * size + 3), (2 * size + 3, 2 * size + 4), (3 * size - 1, 3 * size)]
    many = [(20 * k + 3, 20 * k + 17) for k in range(100_000)]
    cases = [(long, edges), ("key " * 500_000, many), ("x" * (3 * size), [(5, 3 * size - 5)]), ("short", []), ("whole", [(0, 5)])]
    frame = spark.createDataFrame(cases, "text string, spans array<struct<start:long,end:long>>")

    def whole(text, spans):
        at, out = 0, []
        for start, end in spans:
            out += [text[at:start], mask]
            at = end
        return "".join([*out, text[at:]])

    got = [r[0] for r in frame.select(secrets.masked_text(frame["text"], frame["spans"])).collect()]
    assert got == [whole(*c) for c in cases]
