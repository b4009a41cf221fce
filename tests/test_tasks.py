"""How work is dealt: what is read once, and what no task holds whole."""

import glob

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signalbase.operators import classification
from signalbase.operators.search import haystack
from signalbase.plans import fixtures
from signalbase.plans.stats import BuildReport
from signalbase.sources import store, text_index

SMALL = "/root/testdata/sf0.001"


def test_a_store_builds_its_records_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(value):
        calls.add(1)
        return value

    rows = fixtures.classified(spark, SMALL).drop("month").localCheckpoint()
    store.write_store(rows.withColumn("source", F.udf(seen, StringType())("source")), str(tmp_path), BuildReport())
    assert calls.value == rows.count()
    kept = store.read_store(spark, str(tmp_path))
    key = lambda f: sorted(map(str, f.select("ingest_ord", "date", "title", "body", "category").collect()))
    assert key(kept) == key(rows)


def test_dates_are_spread_in_order_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "PART_ROWS", (10, 10))
    rows = fixtures.classified(spark, SMALL).drop("month")
    odd = rows.limit(45).withColumn("ingest_ord", F.col("ingest_ord") + 10**6)
    rows = rows.unionByName(odd.withColumn("date", F.lit("2026-03-15"))).unionByName(odd.withColumn("date", F.lit("unknown"))).localCheckpoint()
    days, parts = store._laid_out(rows)
    assert parts == -(-rows.count() // 10)
    laid = sorted(((r["day"], r["first"], r["spread"]) for r in days.collect()), reverse=True)
    assert laid[0][:2] == ("unknown", 0) and all(a[1] + a[2] - 1 <= b[1] for a, b in zip(laid, laid[1:])) and laid[-1][1] + laid[-1][2] == parts
    assert next(d for d in laid if d[0] == "2026-03-15")[2] >= 4
    store.write_store(rows, str(tmp_path), BuildReport())
    assert store.read_store(spark, str(tmp_path)).count() == rows.count()


def test_grams_of_files_are_those_of_their_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PIECE", 7)
    texts = ["Alpha beta", "", "xy", "世界，你好 alpha", "\U0001f600ab\U0001f600", "ÄÖ zq", "\x00\x01\x02~\x7f", "abcdefghijklmnopqrstuvwxyz" * 3, None]
    columns = ("title", "body", "category", "source", "url", "authors")
    rows = spark.createDataFrame([Row(**{c: t if c == "body" else "" for c in columns}, part=k % 3) for k, t in enumerate(texts)], ", ".join(f"{c} string" for c in columns) + ", part int")
    path = str(tmp_path / "rows")
    rows.repartition(3, "part").write.parquet(path)
    rows = spark.read.parquet(path)
    index = text_index.build_index(rows)
    assert "Generate" not in index._jdf.queryExecution().optimizedPlan().toString()
    held = [(r["file"], r["t"]) for r in rows.select(F.col("_metadata.file_path").alias("file"), haystack().alias("t")).collect()]
    hashes = spark.createDataFrame([(file, t[k : k + 3]) for file, t in held for k in range(len(t) - 2)], "file string, g string").select("file", text_index._hash(F.col("g")).alias("h")).distinct()
    wanted = hashes.groupBy("file", F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    key = lambda f: sorted((r["file"], r["bucket"], bytes(r["bits"])) for r in f.collect())
    assert key(index) == key(wanted)
    for needle in ("\U0001f600ab", "ab\U0001f600", "a\U0001f600", "世界，", "äö z", "pha be"):
        assert set(text_index.files_that_may_hold(spark, index, needle) or []) >= {file for file, t in held if len(needle) > 2 and needle in t}, needle


def test_no_task_holds_a_whole_wave(spark, tmp_path, monkeypatch):
    requests = spark.createDataFrame([("2026-01", k, f'[{{"id": {k}}}]') for k in range(90)], "month string, batch long, items string")
    waves = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/signalbase/waves-*/wave=*"

    def run(name):
        before = set(glob.glob(waves))
        answers = classification.ask_and_keep(requests, lambda items: items, str(tmp_path / name), 1 << 30, workers=3)
        assert sorted((r["batch"], r["answer"]) for r in answers.collect()) == [(k, f'[{{"id": {k}}}]') for k in range(90)]
        return [[spark.read.parquet(f).count() for f in glob.glob(f"{w}/*.parquet")] for w in set(glob.glob(waves)) - before]

    (counts,) = run("one")
    assert sum(counts) == 90 and max(counts) < 90
    monkeypatch.setattr(classification, "TASK_BYTES", 100)
    assert len(run("more")) > 1


def test_the_earlier_store_is_one_pass_over_the_documents(spark):
    plan = fixtures.prior(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1
