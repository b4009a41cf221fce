import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns[:2] and 0 < rows.count() <= 40


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
