import datetime as dt

from signalbase import config
from signalbase.operators.search import Query, category_facets, category_tree, counts, search


def test_query_state():
    q = Query(text=" x ", date_from="2026-01-01", date_to="2026-01-01", category="a-b", kind="news", alert="no", page=3)
    assert [(k, v) for k, _, v in q.describe()] == [("query", "x"), ("date", "2026-01-01"), ("category", "a / b"), ("type", config.NEWS_LABEL), ("alert", config.ALERT_LABELS["no"])]
    assert q.cleared("date") == Query(text=" x ", category="a-b", kind="news", alert="no")
    assert q.toggled("a-b").category == "" and q.toggled("c").category == "c" and q.toggled("c").page == 1
    assert Query(date_from="2026-01-01").describe()[0][2] == "2026-01-01 ~ …"
    day = dt.date(2026, 3, 1)
    assert (Query().quick("7d", day).date_from, Query().quick("30d", day).date_from, Query().quick("today", day).date_to) == ("2026-02-23", "2026-01-31", "2026-03-01")
    assert q.quick("all", day).date_from == ""


ROWS = [
    (0, "unknown", "t0", "b", "a-x", "s", "u", "w", "news", True),
    (1, "2026-02-01", "t1", "Needle", "a-y", "s", "", "w", "news", None),
    (2, "2026-01-15", "t2", None, "", "s", None, "w", "literature", False),
    (3, "2026-02-01", "t3", "", "z", "s", "", "50% off_", "literature", True),
]
SCHEMA = "ingest_ord long, date string, title string, body string, category string, source string, url string, authors string, intelligence_type string, is_alert boolean"


def ids(frame):
    return [r["ingest_ord"] for r in frame.collect()]


def test_filters(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert ids(search(rows, Query())) == [0, 3, 1, 2]
    assert ids(search(rows, Query(date_from="2026-02-01"))) == [0, 3, 1]
    assert ids(search(rows, Query(date_to="2026-02-01"))) == [3, 1, 2]
    assert ids(search(rows, Query(alert="no"))) == [1, 2]
    assert ids(search(rows, Query(text="NEEDLE a-y"))) == [1]
    assert ids(search(rows, Query(text="50% o"))) == [3] and ids(search(rows, Query(text="5_% o"))) == []
    assert ids(search(rows, Query(category=config.UNCLASSIFIED))) == []
    assert counts(rows, Query(text="nothing")).first()["pages"] == 1


def test_facets(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    vocabulary = ["b/q", "a/（x）"]
    got = {r["category"]: (r["n"], r["vocab_ord"]) for r in category_facets(rows, vocabulary).collect()}
    assert got == {"b-q": (0, 0), "a-x": (1, 1), "a-y": (1, None), config.UNCLASSIFIED: (1, None), "z": (1, None)}
    tree = {r["category"]: r for r in category_tree(rows, vocabulary, groups=("z", "a")).collect()}
    assert tree["a-x"]["group_total"] == 2 and tree["a-x"]["group_rank"] == 1 and tree["b-q"]["group_rank"] == 99
    assert {r["category"]: r["group_total"] for r in category_tree(rows, vocabulary, "A/Y").collect()} == {"a-y": 1}


def test_month_bounds_prune_partitions(spark, tmp_path):
    from signalbase.operators.search import matches

    path = str(tmp_path / "store")
    spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "substring(date, 1, 7) AS month").write.partitionBy("month").parquet(path)
    found = matches(spark.read.parquet(path), Query(date_from="2026-02-01", date_to="2026-02-28"))
    assert sorted(ids(found)) == [1, 3]
    assert "PartitionFilters: [isnotnull(month" in found._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_groups_that_span_partitions(spark):
    from pyspark.sql import functions as F

    from signalbase.operators.numbering import numbered

    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.lit("b")).alias("g"), (F.col("id") * 7919 % 5000).alias("k"))
    got = numbered(rows, ["g"], [F.desc("k")], "n").collect()
    groups = {}
    for r in sorted(got, key=lambda r: -r["k"]):
        assert r["n"] == groups.get(r["g"], 0)
        groups[r["g"]] = r["n"] + 1
    assert sum(groups.values()) == 5000 and numbered(rows.filter("false"), ["g"], [F.desc("k")]).count() == 0
