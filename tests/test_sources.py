from pyspark.sql import functions as F

from signalbase import config
from signalbase.operators import classification
from signalbase.operators.records import carry_forward, newest_first
from signalbase.plans.build import build
from signalbase.plans.stats import BuildReport
from signalbase.sources import csv_drops, store
from signalbase.streaming import incremental

NEWS = config.SOURCES[1]
PAPERS = config.SOURCES[2]


def drop(folder, spec, name, content, encoding="utf-8"):
    at = folder / spec.subdir
    at.mkdir(parents=True, exist_ok=True)
    (at / name).write_bytes(content.encode(encoding))


def drops(tmp_path):
    drop(tmp_path / "n", NEWS, "articles-2026-06-30.csv", 'title,content,URL\n"a ""q""","two\nlines",http://x\nshort\nwide,b,c,d,e\n\n')
    drop(tmp_path / "n", NEWS, "articles-2026-07-01.csv", "标题,正文,作者\n新闻,量产,某人\n", "gb18030")
    drop(tmp_path / "n", NEWS, "notes.csv", "title\nno\n")
    drop(tmp_path / "n", NEWS, "articles-2026-07-02.csv", "")
    drop(tmp_path / "p", PAPERS, "news_with_abstract_2026-07-01.csv", "﻿TITLE,abstract,summary,authors,link\nP, ,sum,auth,http://y\n")
    return {NEWS.name: str(tmp_path / "n"), PAPERS.name: str(tmp_path / "p")}


def test_read_sources(spark, tmp_path):
    stats = BuildReport()
    rows = csv_drops.read_sources(spark, drops(tmp_path), report=stats).orderBy("ingest_ord").collect()
    assert [(r["title"], r["body"], r["authors"], r["url"], r["date"], r["intelligence_type"]) for r in rows] == [
        ('a "q"', "two lines", "", "http://x", "2026-06-30", "news"),
        ("short", "", "", "", "2026-06-30", "news"),
        ("wide", "b", "", "c", "2026-06-30", "news"),
        ("新闻", "量产", "某人", "", "2026-07-01", "news"),
        ("P", "sum", "auth", "http://y", "2026-07-01", "literature"),
    ]
    assert rows[0]["source"] == f"{NEWS.name}/articles-2026-06-30.csv"
    assert stats.document()["source_files"] == 4 and stats.warnings == [f"no folder given for {config.SOURCES[0].name}"]


def test_missing_folder_warns(spark, tmp_path):
    stats = BuildReport()
    assert csv_drops.read_source(spark, str(tmp_path), NEWS, stats).count() == 0
    assert stats.warnings == [f"missing folder: {tmp_path}/data"]


def test_build_keeps_earlier_classifications(spark, tmp_path):
    roots, out = drops(tmp_path), str(tmp_path / "store")
    leaves = (config.Leaf(("x", "y"), ("zzz",)),)
    stats = build(spark, roots, out, leaves, "v1")
    assert [stats.document()[k] for k in ("records_total", "records_by_type", "source_files")] == [5, {"news": 4, "literature": 1}, 4]
    first = store.read_store(spark, out)
    assert [r["month"] for r in store.manifest(first).collect()] == ["2026-07", "2026-06"]
    assert first.filter("is_alert").count() == 1
    done = classification.write_back(first.drop("month"), first.filter("title = 'P'").select("ingest_ord", F.lit("a-b").alias("category"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason")), config.TRUSTED_MODELS[0], "p")
    store.write_store(done, out, BuildReport())
    build(spark, roots, out, leaves, "v1")
    again = {r["title"]: r for r in store.read_store(spark, out).collect()}
    assert again["P"]["category"] == "a-b" and again["P"]["classifier_model"] == config.TRUSTED_MODELS[0] and again["P"]["cache_hit"] is False
    assert again["short"]["category"] == config.UNCLASSIFIED and len(again) == 5
    at = store.newest(spark, out)
    docs = spark.read.json(f"{at}/knowledge")
    assert {r["category"] for r in docs.collect()} == {"x-y", "a-b", config.UNCLASSIFIED}
    assert store.load_json(spark, f"{at}/meta", None)["taxonomy_version"] == "v1"
    assert store.load_json(spark, f"{at}/nothing", 7) == 7


def test_empty_store(spark, tmp_path):
    assert store.read_store(spark, str(tmp_path / "none")).count() == 0


def test_carry_forward_keeps_the_number_of_rows(spark, tmp_path):
    build(spark, drops(tmp_path), str(tmp_path / "s"))
    rows = store.read_store(spark, str(tmp_path / "s")).drop("month")
    twice = rows.unionByName(rows).withColumns({"classifier_model": F.lit(config.TRUSTED_MODELS[1]), "category": F.lit("c")})
    assert carry_forward(rows, twice).filter("category = 'c'").count() == rows.count()


def test_taxonomy_and_vocabulary(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"version": "v", "leaves": [{"id": "i", "label": "l", "path": ["a", "b"], "keywords": ["k"]}]}')
    (tmp_path / "v.json").write_text('{"categories": ["a/b", "c"]}')
    assert store.read_taxonomy(spark, str(tmp_path / "t.json")) == ("v", [config.Leaf(("a", "b"), ("k",), "l")])
    assert store.read_vocabulary(spark, str(tmp_path / "v.json")) == ["a/b", "c"]
    assert store.read_taxonomy(spark, str(tmp_path / "no.json")) == ("unknown", []) and store.read_vocabulary(spark, str(tmp_path / "no.json")) == []


def test_failing_model_gives_fallback_rows(spark, tmp_path):
    build(spark, drops(tmp_path), str(tmp_path / "s"))
    rows = store.read_store(spark, str(tmp_path / "s")).drop("month")

    def broken(items):
        raise RuntimeError("out of order")

    done = classification.classify_records(rows, broken, ["a"], "m", "p", newest_first(), attempts=2, pause=0.0)
    got = {(r["category"], r["classification_reason"]) for r in done.collect()}
    assert got == {(config.UNRELATED, "LLM batch parse failed: out of order")}


def test_single_records_are_asked_one_by_one(spark, tmp_path):
    build(spark, drops(tmp_path), str(tmp_path / "s"))
    rows = store.read_store(spark, str(tmp_path / "s")).drop("month")

    def one(prompt):
        assert prompt.startswith("Sort this: [{") and prompt.count('"title"') == 1
        return "so be it" if '"wide"' in prompt else '```json\n{"category": "a/b", "confidence": 0.5}\n```'

    done = classification.classify_records(rows, one, ["a/b"], "m", "p", newest_first(), pause=0.0, template="Sort this: {items}", single=True, limit=4)
    got = {r["title"]: (r["category"], r["classification_confidence"], r["classification_reason"], r["classifier_model"]) for r in done.collect()}
    assert got["P"] == ("a-b", 0.5, "", "m") and got["wide"] == (config.UNRELATED, 0.0, "LLM output parse failed: so be it", "m")
    assert sum(v[3] == "m" for v in got.values()) == 4


def test_stream_of_drops(spark, tmp_path):
    drop(tmp_path, NEWS, "articles-2026-06-30.csv", "title,content\nt,first\n")
    start = lambda: incremental.follow(spark, str(tmp_path / NEWS.subdir), NEWS, ["title", "content"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert start()
    drop(tmp_path, NEWS, "articles-2026-07-01.csv", "title,content\nu,b\n")
    assert start()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("date").collect()
    assert [(r["title"], r["is_alert"], r["month"]) for r in rows] == [("t", True, "2026-06"), ("u", False, "2026-07")]


def test_documents_of_a_generation(spark, tmp_path):
    out = str(tmp_path / "store")
    leaves = (config.Leaf(("x", "y"), ("zzz",)),)
    report = build(spark, drops(tmp_path), out, leaves, "v1", form="parquet")
    at = store.newest(spark, out)
    meta = store.load_json(spark, f"{at}/meta", None)
    assert list(meta) == list(config.META_KEYS) and meta == report.document()
    manifest = store.load_json(spark, f"{at}/manifest", None)
    assert manifest["meta"] == meta and sum(x["records"] for x in manifest["shards"]) == meta["records_total"] and manifest["knowledge_index"] == "knowledge_index"
    index = store.load_json(spark, f"{at}/knowledge_index", None)
    assert index["generated_at"] == report.at and [d["category"] for d in index["documents"]] == ["x-y", config.UNCLASSIFIED] and index["documents"][0]["updated_at"] == report.at
    snapshot = store.load_json(spark, f"{at}/snapshot", None)
    titles = [r["title"] for r in store.read_store(spark, out).orderBy(*newest_first()).collect()]
    assert [r["title"] for r in snapshot["records"]] == titles and snapshot["knowledge"] == index["documents"] and snapshot["meta"]["records_total"] == 5
    assert "PartitionFilters: [isnotnull(month" in store.read_store(spark, out).filter("month = '2026-06'")._jdf.queryExecution().toString()


def test_old_generations_go_and_bad_files_are_passed_over(spark, tmp_path):
    import glob

    out = str(tmp_path / "store")
    for _ in range(3):
        build(spark, drops(tmp_path), out)
    assert len(store.generations(spark, out)) == 3 and len(store.prune(spark, out, 2)) == 1
    assert len(glob.glob(f"{out}/generations/*")) == 2 and store.read_store(spark, out).count() == 5
    shard = glob.glob(f"{store.newest(spark, out)}/processed/month=2026-06")[0]
    with open(f"{shard}/broken.json.gz", "wb") as f:
        f.write(b"no gzip")
    assert store.read_store(spark, out).count() == 5


def items_of(spark, n):
    return spark.range(n).select(F.lit("2026-01").alias("month"), F.col("id").alias("batch"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("items"))


def test_answers_that_do_not_parse_are_asked_again_in_several_tasks(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def flaky(items):
        import os

        from pyspark import TaskContext

        with open(seen / f"{items}-{len(os.listdir(seen))}-{TaskContext.get().partitionId()}-{os.urandom(4).hex()}", "w"):
            pass
        tries = sum(x.startswith(f"{items}-") for x in os.listdir(seen))
        return "not json" if tries < 3 else "[]"

    got = classification.ask(items_of(spark, 24), flaky, attempts=3, pause=0.0, workers=4).collect()
    assert {r["answer"] for r in got} == {"[]"} and len(got) == 24
    names = [x.name for x in seen.iterdir()]
    assert len(names) == 72 and len({x.split("-")[2] for x in names}) == 4
    again = classification.ask(items_of(spark, 1).withColumn("items", F.lit("z")), lambda _: "never", attempts=3, pause=0.0).first()
    assert again["answer"] == "never"


def test_a_call_that_takes_too_long_is_given_up(spark):
    def slow(items):
        import time

        time.sleep(30)

    got = classification.ask(items_of(spark, 1), slow, attempts=1, seconds=0.2).first()
    assert got["answer"] == "no answer after 0.2 s"


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def model(items):
        with open(log / items, "a") as f:
            f.write("x")
        return "[1]"

    folder = str(tmp_path / "answers")
    some = items_of(spark, 40).filter("batch < 25")
    assert classification.ask_and_keep(some, model, folder, flush=10, pause=0.0).count() == 25
    got = classification.ask_and_keep(items_of(spark, 40), model, folder, flush=10, pause=0.0)
    assert got.count() == 40 and {r["answer"] for r in got.collect()} == {"[1]"}
    assert sorted(x.name for x in log.iterdir()) == sorted(f"q{k}" for k in range(40)) and all(x.read_text() == "x" for x in log.iterdir())


def test_quoted_ids_and_the_fallback_of_a_date(spark, tmp_path):
    build(spark, drops(tmp_path), str(tmp_path / "s"))
    rows = store.read_store(spark, str(tmp_path / "s")).drop("month")
    answer = '[{"id": "0", "category": "a/b", "confidence": "0.75", "reason": "r"}]'
    done = classification.classify_records(rows, lambda _: answer, ["a/b"], "m", "p", newest_first(), pause=0.0, month="2026-07", batch_size=5)
    got = {(r["category"], r["classification_confidence"], r["classification_reason"]) for r in done.filter("date like '2026-07%'").collect()}
    assert ("a-b", 0.75, "r") in got and (config.UNRELATED, 0.0, config.MISSING_REASON) in got
    long = "no " * 100
    done = classification.classify_records(rows, lambda _: long, ["a/b"], "m", "p", newest_first(), pause=0.0, attempts=1, date="2026-07-01")
    reason = {r["classification_reason"] for r in done.filter("date = '2026-07-01'").collect()}
    assert reason == {"LLM batch output parse failed: " + long[:160]}
