import pytest

from signalbase.plans import catalog
from tests.compare import both

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    ours, theirs = both(catalog.queries()[name](spark, SMALL), catalog.oracle_sql()[name], SMALL)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0


def test_counts_add_up(spark):
    total = catalog.queries()["meta_stats"](spark, SMALL).first()
    shards = catalog.queries()["shard_counts"](spark, SMALL).groupBy().sum("records").first()[0]
    assert total["records_total"] == total["news"] + total["literature"] == shards


def test_pages_join_to_the_sorted_list(spark):
    from signalbase.operators import search
    from signalbase.plans import fixtures

    rows = fixtures.classified(spark, SMALL).select("ingest_ord", "date", "title", "intelligence_type", "category")
    pages = [r["ingest_ord"] for n in range(1, 4) for r in search.search(rows, search.Query(kind="news", page=n, page_size=25)).collect()]
    whole = [r["ingest_ord"] for r in catalog.rec.sorted_records(rows.filter("intelligence_type = 'news'")).collect()]
    assert pages[: len(whole)] == whole[:75]
    last = search.search(rows, search.Query(kind="news", page=99, page_size=25)).collect()
    assert [r["ingest_ord"] for r in last] == whole[(len(whole) - 1) // 25 * 25 :]


def test_scans_read_only_what_they_need(spark):
    plan = catalog.queries()["shard_counts"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan
