"""Stores brought up to date by months, the state of classifications, the text index, and the term index."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import classify
from signalbase.operators import term_index
from signalbase.operators.records import build_records, carry_forward, newest_first
from signalbase.operators.search import Query, matches
from signalbase.plans import build as plans
from signalbase.plans import fixtures
from signalbase.plans.stats import BuildReport
from signalbase.sources import state, store

NEWS = config.SOURCES[1]
SMALL = "/root/testdata/sf0.001"


def drop(root, day, *rows):
    folder = root / NEWS.subdir
    folder.mkdir(exist_ok=True)
    (folder / f"articles-{day}.csv").write_text("title,content\n" + "".join(f"{t},{b}\n" for t, b in rows))


def shown(spark, folder):
    return sorted((r["date"], r["title"], r["body"], r["category"]) for r in store.read_store(spark, folder).collect())


def test_a_drop_of_one_day_writes_one_month_and_reads_no_other(spark, tmp_path):
    roots, out = {NEWS.name: str(tmp_path)}, str(tmp_path / "store")
    drop(tmp_path, "2026-05-01", ("old", "may"))
    drop(tmp_path, "2026-06-02", ("t", "june"), ("u", "june too"))
    drop(tmp_path, "2026-07-03", ("v", "july"))
    plans.build(spark, roots, out)
    drop(tmp_path, "2026-06-20", ("w", "june again"))
    # Whatever would read another month's shard or drop now fails or loses its rows.
    for path in glob.glob(f"{out}/generations/*/processed/month=2026-05/*.parquet"):
        with open(path, "wb") as f:
            f.write(b"unreadable")
    report, months = plans.update(spark, roots, out)
    assert months == ["2026-06"] and report.total == 5
    at = store.newest(spark, out)
    assert [p.split("=")[-1] for p in glob.glob(f"{at}/processed/month=*")] == ["2026-06"]
    assert [(r[0], r[1]) for r in shown(spark, out)] == [("2026-06-02", "t"), ("2026-06-02", "u"), ("2026-06-20", "w"), ("2026-07-03", "v")]
    shards = store.load_json(spark, f"{at}/manifest", None)["shards"]
    assert [(s["month"], s["records"], s["holder"] == at) for s in shards] == [("2026-07", 1, False), ("2026-06", 3, True), ("2026-05", 1, False)]
    assert plans.update(spark, roots, out)[1] == []


def test_an_update_equals_a_build(spark, tmp_path):
    roots, one, two = {NEWS.name: str(tmp_path)}, str(tmp_path / "one"), str(tmp_path / "two")
    drop(tmp_path, "2026-05-01", ("a", "x"), ("b", "y"))
    drop(tmp_path, "2026-06-02", ("c", "z"))
    for out in (one, two):
        plans.build(spark, roots, out)
        done = store.read_store(spark, out).drop("month").withColumns({"category": F.concat(F.lit("c-"), "title"), "classifier_model": F.lit(config.TRUSTED_MODELS[0])})
        store.write_store(done, out, BuildReport())
    drop(tmp_path, "2026-06-02", ("c", "z"), ("b", "y"))
    drop(tmp_path, "2026-08-09", ("a", "x"), ("new", "n"))
    (tmp_path / NEWS.subdir / "articles-2026-05-01.csv").unlink()
    # The full build writes all its files anew; the generation before it did not list its files, so the first update is whole as well.
    plans.build(spark, roots, one)
    assert plans.update(spark, roots, two)[1] == ["2026-06", "2026-08"]
    assert shown(spark, one) == shown(spark, two)
    assert shown(spark, one) == [("2026-06-02", "b", "y", "c-b"), ("2026-06-02", "c", "z", "c-c"), ("2026-08-09", "a", "x", "c-a"), ("2026-08-09", "new", "n", config.UNCLASSIFIED)]
    drop(tmp_path, "2026-09-01", ("later", "l"), ("a", "x"))
    (tmp_path / NEWS.subdir / "articles-2026-08-09.csv").unlink()
    report, months = plans.update(spark, roots, two)
    assert months == ["2026-08", "2026-09"] and report.total == 4
    plans.build(spark, roots, one)
    assert shown(spark, one) == shown(spark, two)
    assert [s["month"] for s in store.load_json(spark, f"{store.newest(spark, two)}/manifest", None)["shards"]] == ["2026-09", "2026-06"]


def test_generations_that_hold_months_are_not_pruned(spark, tmp_path):
    roots, out = {NEWS.name: str(tmp_path)}, str(tmp_path / "store")
    drop(tmp_path, "2026-05-01", ("a", "x"))
    plans.build(spark, roots, out)
    for day in range(1, 5):
        drop(tmp_path, f"2026-06-0{day}", (f"t{day}", "y"))
        plans.update(spark, roots, out, keep=1)
    assert len(shown(spark, out)) == 5 and len(store.generations(spark, out)) == 5
    assert len(glob.glob(f"{out}/generations/*")) == 2
    assert store.load_json(spark, f"{store.newest(spark, out)}/meta", None)["records_total"] == 5


def test_lines_that_are_no_json_and_dates_that_no_calendar_has(spark, tmp_path):
    roots, out = {NEWS.name: str(tmp_path)}, str(tmp_path / "store")
    for day in ("2026-02-30", "2026-02-27", "2026-99-99"):
        drop(tmp_path, day, (f"t{day}", "a"), (f"u{day}", "b"))
    plans.build(spark, roots, out, form="json")
    (shard,) = glob.glob(f"{store.newest(spark, out)}/processed/month=2026-02")
    with open(f"{shard}/broken.json", "w") as f:
        f.write('{"title": "half a li\nno json at all\n')
    rows = store.read_store(spark, out).orderBy("ingest_ord").collect()
    assert [r["title"][1:] for r in rows] == [d for d in ("2026-02-27", "2026-02-30", "2026-99-99") for _ in "ab"] and store.read_store(spark, out).count() == 6
    assert len({r["ingest_ord"] for r in rows}) == 6 and rows[-1]["month" if "month" in rows[-1] else "date"].startswith("2026-99")


def test_the_state_is_joined_and_merged_without_a_shuffle(spark, tmp_path):
    folder = str(tmp_path)
    rows = fixtures.prior(spark, SMALL)
    kept = state.write_state(state.latest(rows.filter("ingest_ord % 2 = 0")), folder, 8)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = build_records(fixtures.records(spark, SMALL))
        joined = state.carry_from_state(fresh, kept)
        both = state.merged(kept, state.latest(rows))
        for plan in (joined, both):
            text = plan._jdf.queryExecution().executedPlan().toString()
            own = text[: text.index("signalbase_state_")].split("\n")
            depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
            # From the state's scan up to the join there is a sort at most.
            at, above = depth(own[-1]), []
            for line in reversed(own[:-1]):
                if depth(line) < at:
                    at = depth(line)
                    above.append(line)
                    if "Join" in line:
                        break
            assert above and "Join" in above[-1] and not any("Exchange" in x for x in above), text
        kept = state.write_state(both, folder, 8)
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, state.latest(rows).collect()))
        wanted = carry_forward(fresh, rows).select("ingest_ord", "category", "classifier_model", "classification_confidence")
        assert sorted(map(tuple, state.carry_from_state(fresh, kept).select(*wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_needle_of_one_month_reads_only_files_that_may_hold_it(spark, tmp_path):
    out = str(tmp_path / "store")
    rows = fixtures.classified(spark, SMALL).drop("month")
    odd = rows.filter("date = '2026-03-15'").limit(1).withColumns({"body": F.lit("a Zqj-7719 needle ÄÖ"), "ingest_ord": F.lit(10**9)})
    store.write_store(rows.unionByName(odd), out, BuildReport())
    every = store.read_store(spark, out)
    assert len(every.inputFiles()) > 4
    for text in ("zQJ-7719", " äö ", "zq", "the", "no such text at all", "", "tion of the"):
        query = Query(text=text)
        found = store.search_store(spark, out, query)
        assert sorted(r["ingest_ord"] for r in found.collect()) == sorted(r["ingest_ord"] for r in matches(every, query).collect()), text
    files = store.search_files(spark, out, Query(text="zQJ-7719")).inputFiles()
    assert files and all("month=2026-03" in f for f in files)
    assert not store.search_files(spark, out, Query(text="zQJ-7719", date_from="2026-04-01")).inputFiles()
    assert {f.split("/")[-2] for f in store.search_files(spark, out, Query(date_from="2026-05-01", date_to="2026-06-30")).inputFiles()} == {"month=2026-05", "month=2026-06"}


LEAVES = (config.Leaf(("a", "ab"), ("abc", "abc", "ABCD")), config.Leaf(("x",), ("é", "世界", "")), config.Leaf((), ("longer term", "\U0001f600b"), "label"), config.Leaf(("b",), ("ab",)), config.Leaf(("none",), ()))


@pytest.mark.parametrize("limit", [term_index.BROADCAST_TERMS, 0])
def test_terms_by_index_equal_terms_as_literals(spark, limit):
    texts = ["xxABCDxx", "É", "in 世界 here", "a longer Term\nab", "", None, "\U0001f600B", "zz", "ab", "abcabcabcd"]
    frame = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(texts + texts[:2])] + [(None, "abc", "y", 1)], "key long, text string, term string, ord int")
    got = term_index.classify(frame, ["key"], F.col("text"), term_index.leaf_table(spark, LEAVES), limit)
    wanted = frame.select("key", classify.classify_leaf(F.col("text"), LEAVES).alias("c")).select("key", "c.category", "c.score", "c.confidence")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
    empty = term_index.classify(frame, ["key"], F.col("text"), term_index.leaf_table(spark, LEAVES).limit(0), limit)
    assert {r["category"] for r in empty.collect()} == {config.UNCLASSIFIED} and empty.count() == len(texts) + 3


def test_a_hundred_thousand_terms_without_a_nested_loop(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    some = random.Random(7)
    words = sorted({w for r in docs.collect() for w in r["text"].lower().split()})
    pieces = {w[i : i + n] for w in words for n in (3, 5, 8) for i in range(0, max(1, len(w) - n))}
    terms = set(some.sample(sorted(pieces | set(words)), min(30_000, len(pieces))))
    terms |= {"".join(some.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(some.randint(3, 9))) for _ in range(110_000)}
    terms = sorted(terms)[:100_000]
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    found = term_index.contained(docs, ["doc_id"], F.col("text"), frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["term"])
    import ahocorasick

    machine = ahocorasick.Automaton()
    for t in terms:
        machine.add_word(t, t)
    machine.make_automaton()
    assert got == {r["doc_id"]: s for r in docs.collect() if (s := {t for _, t in machine.iter(r["text"].lower())})}


def test_the_snapshot_reads_the_newest_months(spark, tmp_path):
    out = str(tmp_path / "store")
    rows = fixtures.classified(spark, SMALL).drop("month")
    store.write_store(rows, out, BuildReport())
    snapshot = store.load_json(spark, f"{store.newest(spark, out)}/snapshot", None)
    wanted = [r["ingest_ord"] for r in store.snapshot_head(rows).orderBy(*newest_first()).collect()]
    assert [r["ingest_ord"] for r in snapshot["records"]] == wanted


@pytest.mark.parametrize("limit", [term_index.BROADCAST_TERMS, 0])
def test_terms_are_looked_for_in_words_and_verified_in_texts_only_where_they_hold_white_space(spark, limit):
    texts = ["alphabetic betas, alphabetic", "the  alphabetic\tsoup of betas", "世界，你好世界。", "soup\tof", " ", "", None, "soup of betasx and x soup", "longwordwithoutanyspaceatall"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "null key betas")], "key int, text string")
    bare = ["alphabet", "betas", "beta", "as,", "世界", "你好", "wordwith", "a", "s", "none", "th", "spaceatallx"]
    spaced = ["soup of", "p of b", "betas, alpha", "\t", " ", "  ", "世界，你", "好世界。", "，", "null key b", "x soup x"]
    for terms in (bare, bare + spaced):
        got = term_index.contained(frame, ["key"], F.col("text"), spark.createDataFrame([(t,) for t in terms], "term string"), limit)
        wanted = {(k, t) for k, x in [*enumerate(texts), (None, "null key betas")] for t in terms if x and t in x}
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == wanted
        assert ("Contains(_low" in got._jdf.queryExecution().optimizedPlan().toString()) == (terms is not bare)
