"""A store's summaries, pages and seeks, and model answers with misshapen elements."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from signalbase.functions import classify
from signalbase.operators import search
from signalbase.operators.records import newest_first
from signalbase.operators.search import Query
from signalbase.plans import fixtures
from signalbase.plans.stats import BuildReport
from signalbase.sources import store, summaries

SMALL = "/root/testdata/sf0.001"
QUERIES = [
    Query(page_size=30),
    Query(kind="news", alert="yes", page_size=7),
    Query(date_from="2026-01-10", date_to="2026-03-05", page_size=11),
    Query(category="beta-und", page_size=3),
    Query(text="tion of", page_size=5),
    Query(kind="nothing"),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("s") / "store")
    rows = fixtures.classified(spark, SMALL)
    rows = rows.withColumns({"is_alert": F.when(F.col("ingest_ord") % 5 > 0, F.col("is_alert")), "category": F.when(F.col("ingest_ord") % 11 > 0, F.col("category"))})
    store.write_store(rows, folder, BuildReport())
    return folder


def shown(frame):
    return [(r["date"], r["title"], r["ingest_ord"]) for r in frame.collect()]


@pytest.mark.parametrize("query", QUERIES, ids=str)
def test_pages_and_seeks_equal_the_search(spark, stored, query):
    from dataclasses import replace

    whole = shown(search.matches(store.read_store(spark, stored), query).orderBy(*newest_first()))
    size = query.page_size
    last = max(1, -(-len(whole) // size))
    for page in sorted({1, 2, last // 2 + 1, last}):
        at = (min(page, last) - 1) * size
        assert shown(store.store_page(spark, stored, replace(query, page=page))) == whole[at : at + size]
        if at + size < len(whole):
            assert shown(store.page_after(spark, stored, query, whole[at + size - 1])) == whole[at + size : at + 2 * size]
    assert shown(store.store_page(spark, stored, replace(query, page=10_000))) == whole[(last - 1) * size :]
    if whole:
        assert shown(store.page_after(spark, stored, query, whole[-1])) == []


def test_a_late_page_reads_only_its_months(spark, stored):
    at = [r["date"] for r in store.store_page(spark, stored, Query(page=4, page_size=10)).collect()]
    files = store.store_page(spark, stored, Query(page=4, page_size=10)).inputFiles()
    assert files and {f.split("month=")[1].split("/")[0] for f in files} == {d[:7] for d in at}


def test_facets_and_counts_equal_those_of_the_records(spark, stored):
    records, summary = store.read_store(spark, stored), store.read_summary(spark, stored)
    rows = lambda frame: sorted(map(str, frame.collect()))
    assert rows(summaries.category_tree(summary, fixtures.VOCABULARY)) == rows(search.category_tree(records, fixtures.VOCABULARY))
    assert rows(summaries.category_tree(summary, fixtures.VOCABULARY, "Pha/T")) == rows(search.category_tree(records, fixtures.VOCABULARY, "Pha/T"))
    for query in QUERIES:
        if not query.needle:
            assert summaries.counts(summary, query).first() == search.counts(records, query).first()
    with pytest.raises(ValueError):
        summaries.counts(summary, Query(text="x"))
    head = summaries.header(summary).first()
    assert tuple(head) == (*search.header_counts(records).first(), search.latest_date(records).first()["latest"])


def test_summaries_of_an_update_and_of_a_store_without_them(spark, tmp_path):
    import shutil

    folder = str(tmp_path / "store")
    rows = fixtures.classified(spark, SMALL)
    first = store.write_store(rows, folder, BuildReport())
    march = rows.filter("date like '2026-03%'").withColumn("category", F.lit("changed"))
    store.write_store(march, folder, BuildReport(), months=["2026-03"])
    want = sorted(map(str, summaries.summarise(store.read_store(spark, folder)).collect()))
    assert sorted(map(str, store.read_summary(spark, folder).collect())) == want
    shutil.rmtree(f"{first}/summary")
    assert sorted(map(str, store.read_summary(spark, folder).collect())) == want
    empty = str(tmp_path / "none")
    assert store.read_summary(spark, empty).count() == 0 and store.store_page(spark, empty, Query(page=3)).count() == 0
    assert tuple(summaries.header(store.read_summary(spark, empty)).first()) == (0, 0, 0, "")
    assert glob.glob(f"{folder}/generations/*/text_index")


ANSWERS = [
    ('[{"id": 0, "category": "a", "confidence": 0.5, "reason": "r"}, 7, "noise", null, [1], {"id": "1", "confidence": "0.25"}]', [(0, "a", 0.5, "r"), (1, None, 0.25, None)]),
    ('[{"id": {"x": 1}, "category": "a", "confidence": "high"}, {"id": 2.0}]', [(None, "a", None, None), (2, None, None, None)]),
    ("[]", []),
    ('[{"id": 0}] and [{"id": 1}]', None),
    ('{"id": 0}', None),
    ("no idea", None),
    ("", None),
    (None, None),
    ('[{"id": 0', None),
]


def test_misshapen_elements_do_not_lose_the_others(spark):
    frame = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(ANSWERS)], "k int, answer string")
    got = {r["k"]: r["a"] for r in frame.select("k", classify.parse_model_array(F.col("answer")).alias("a")).collect()}
    assert {k: None if v is None else [tuple(x) for x in v] for k, v in got.items()} == {k: want for k, (_, want) in enumerate(ANSWERS)}


def test_objects_are_read_as_python_reads_them(spark):
    texts = ['{"id": 3, "category": "a", "confidence": 1, "reason": ""}', "[1]", '{"id": 0} {"id": 1}', '{"id": 0}, {"id": 1}', "{'id': 0}", '{"id": 4,}', "7", "", '```json\n{"id": 5}\n```']

    def read(text):
        inner = text[text.find("{") : text.rfind("}") + 1] if "{" in text else text
        try:
            value = json.loads(inner)
        except ValueError:
            return None
        return value.get("id") if isinstance(value, dict) else None

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", classify.parse_model_object(F.col("t"))["id"].alias("id")).collect()
    assert [(r["t"], r["id"]) for r in got] == [(t, read(t)) for t in texts]
