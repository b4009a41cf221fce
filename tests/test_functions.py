import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import classify, extract, text


def value(spark, column, **fields):
    return spark.createDataFrame([Row(**fields)]).select(column.alias("v")).first()["v"] if fields else spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "cleaned"), [("  a　\n b ", "a b"), ("a\x1cb\x85c d", "a b c d"), ("", ""), ("a​b", "a​b")])
def test_clean(spark, raw, cleaned):
    assert value(spark, text.clean(F.lit(raw))) == cleaned
    assert value(spark, text.clean(text.clean(F.lit(raw)))) == cleaned


def test_clean_null(spark):
    assert value(spark, text.clean(F.lit(None))) == ""


def test_pick(spark):
    row = spark.createDataFrame([(" ", "y", "z")], ["标题", "Title", "URL"])
    got = lambda *aliases: row.select(text.pick(row.columns, aliases).alias("v")).first()["v"]
    assert got("标题", "title") == "y" and got("url") == "z" and got("标题") == "" and got("none") == ""


@pytest.mark.parametrize(("name", "date"), [("articles-2026-06-30.csv", "2026-06-30"), ("x.csv", "unknown")])
def test_file_date(spark, name, date):
    assert value(spark, text.file_date(F.lit(name))) == date


def test_month_key(spark):
    assert value(spark, text.month_key(F.lit(""))) == "unknown" == value(spark, text.month_key(F.lit(None).cast("string")))


def test_hash_keeps_the_place_of_empty_fields(spark):
    import hashlib

    got = value(spark, text.content_hash(F.lit("t"), F.lit(None).cast("string"), F.lit("a"), F.lit("")))
    assert got == hashlib.sha256(b"t  a ").hexdigest()


PARAMS = [
    ("5MWh", [("5M", 5.0, "M")]),
    ("10 kWh", [("10 kW", 10.0, "kW")]),
    ("12 GW", [("12 G", 12.0, "G")]),
    ("3.5 mAh", [("3.5 m", 3.5, "m")]),
    ("100 ms", [("100 m", 100.0, "m")]),
    ("10kV", [("10kV", 10.0, "kV")]),
    ("25 ℃", [("25 ℃", 25.0, "℃")]),
    ("25°C", [("25°C", 25.0, "°C")]),
    ("3倍", [("3倍", 3.0, "倍")]),
    ("5亿元", [("5亿元", 5.0, "亿元")]),
    ("10-20%", [("20%", 20.0, "%")]),
    ("1,200 kg", [("200 kg", 200.0, "kg")]),
    ("-40℃", [("40℃", 40.0, "℃")]),
    ("7 天", []),
    ("５ｋ", []),
    ("５k", [("５k", 5.0, "k")]),
    ("5K", [("5K", 5.0, "K")]),
    ("", []),
]


@pytest.mark.parametrize(("raw", "wanted"), PARAMS)
def test_extract_params(spark, raw, wanted):
    got = value(spark, extract.extract_params(F.lit(raw)))
    assert [(p["value_raw"], p["value_numeric"], p["unit"]) for p in got] == wanted


def test_extract_keeps_the_first_eight_over_sentences(spark):
    got = value(spark, extract.extract_params(F.lit("1 kg 2 kg。 3 kg 4 kg 5 kg! 6 kg 7 kg 8 kg? 9 kg")))
    assert [p["value_numeric"] for p in got] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    assert got[2]["evidence_text"] == "3 kg 4 kg 5 kg!" and got[0]["confidence"] == 0.85


def test_null_text_has_no_params(spark):
    assert value(spark, extract.extract_params(F.lit(None).cast("string"))) == []


LEAVES = (
    config.Leaf(("a", "copper"), ("a", "copper")),
    config.Leaf(("a", "cells", "lithium"), ("a", "cells", "lithium")),
    config.Leaf((), ("hospital",), "label"),
)


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [("LITHIUM", ("a-cells-lithium", 4.0, 0.65)), ("a", ("a-copper", 4.0, 0.65)), ("hospitl", (config.UNCLASSIFIED, 0.0, 0.0)), ("hospital", ("a-copper", 4.0, 0.65)), ("a copper cells lithium", ("a-cells-lithium", 12.0, 0.95))],
)
def test_classify_leaf(spark, raw, wanted):
    got = value(spark, classify.classify_leaf(F.lit(raw), LEAVES))
    assert (got["category"], got["score"], round(got["confidence"], 9)) == wanted


def test_a_leaf_without_a_path_goes_by_its_label(spark):
    got = value(spark, classify.classify_leaf(F.lit("xhospitlx hospitxl"), (config.Leaf((), ("hospitxl",), "label"),)))
    assert (got["category"], got["confidence"]) == ("label", 0.6)


@pytest.mark.parametrize(("title", "body", "flag"), [("First pilot", "", True), ("A", "b", False), (None, "量产", True), ("firstly", None, True)])
def test_alert(spark, title, body, flag):
    assert value(spark, classify.alert_flag(F.lit(title).cast("string"), F.lit(body).cast("string"))) is flag


def test_categories(spark):
    path = "零碳产业/物质循环/有机物（碳循环）/CCUS"
    assert value(spark, text.normalize_category(F.lit(path))) == "零碳产业-物质循环-有机物碳循环-CCUS"
    assert value(spark, text.normalize_category_ui(F.lit("a(b)/c"))) == "ab-c"
    assert value(spark, classify.vocab_guard(F.lit(path), [path])) == "零碳产业-物质循环-有机物碳循环-CCUS"
    assert value(spark, classify.vocab_guard(F.lit("零碳产业-物质循环"), [path])) == config.UNRELATED
    assert value(spark, classify.vocab_guard(F.lit(None).cast("string"), [path])) == config.UNRELATED


@pytest.mark.parametrize(("answer", "ids"), [('[{"id": 1}]', [1]), ('```json\n[{"id": 2}]\n```', [2]), ('so: [{"id": 3}] ok', [3]), ("none", None), ("", None)])
def test_model_array(spark, answer, ids):
    got = value(spark, classify.parse_model_array(F.lit(answer)))
    assert (got and [r["id"] for r in got]) == ids


@pytest.mark.parametrize(("answer", "category"), [('{"category": "x", "confidence": 0.5}', "x"), ('```json\n{"category": "y"}\n```', "y"), ("I say {\"category\": \"z\"}", "z"), ("none", None)])
def test_model_object(spark, answer, category):
    got = value(spark, classify.parse_model_object(F.lit(answer)))
    assert (None if got is None else got["category"]) == category and (got is None) == (category is None)


def test_escape_and_preview(spark):
    assert value(spark, text.html_escape(F.lit("<a href=\"x\">'&'</a>"))) == "&lt;a href=&quot;x&quot;&gt;'&amp;'&lt;/a&gt;"
    assert value(spark, text.preview(F.lit("\U0001f600" * 400))) == "\U0001f600" * 300
    assert value(spark, text.preview(F.lit(""))) == config.NO_BODY
