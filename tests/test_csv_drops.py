"""Drops read by Spark's CSV reader against those that Python takes apart."""

import csv
import io
import random
from dataclasses import replace

from pyspark.sql import functions as F

from signalbase import config
from signalbase.sources import csv_drops

NEWS = config.SOURCES[1]
COLUMNS = ("title", "body", "authors", "url")


def written(root, day, content):
    folder = root / NEWS.subdir
    folder.mkdir(exist_ok=True)
    (folder / f"articles-{day}.csv").write_bytes(content)


def by_python(spark, root):
    """All files through Python, whatever they hold."""
    return csv_drops._decoded(spark, [p for p, _, size, _ in csv_drops.drop_files(spark, str(root), NEWS) if size], NEWS)


def shown(frame):
    """Records of each file in order; where ``row`` begins and whether it skips is the reader's own."""
    return [tuple(r)[:-1] for r in frame.select("file_name", *COLUMNS, "date", "source", "row").orderBy("file_name", "row").collect()]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_utf8_drops_are_read_without_python(spark, tmp_path):
    written(tmp_path, "2026-06-01", '﻿title,content,URL\r\n"a ""q""","two\r\nlines",http://x\r\nshort\r\nwide,b,c,d,e\r\n\r\n  \r\n'.encode())
    written(tmp_path, "2026-06-02", "URL,Title,title,CONTENT\nu,not this,this,b\n,only,,\n".encode())
    written(tmp_path, "2026-06-03", b"title,content\n")
    written(tmp_path, "2026-06-04", b"")
    written(tmp_path, "2026-06-05", b'nothing,known\n1,2\n"",""\n')
    got = csv_drops.read_source(spark, str(tmp_path), NEWS)
    assert "MapInPandas" not in plan(got) and plan(got).count("FileScan csv") == 4
    assert shown(got) == shown(by_python(spark, tmp_path))
    assert [r[1:5] for r in shown(got)] == [('a "q"', "two lines", "", "http://x"), ("short", "", "", ""), ("wide", "b", "", "c"), ("", "", "", ""), ("this", "b", "", "u"), ("", "", "", ""), ("", "", "", ""), ("", "", "", "")]
    # Only the columns that the header gives a meaning are parsed.
    titles = plan(csv_drops.read_source(spark, str(tmp_path), NEWS).select("title"))
    assert "ReadSchema: struct<c0:string>" in titles


def test_what_the_readers_take_apart_differently_goes_through_python(spark, tmp_path):
    odd = {
        "2026-06-01": "title,content\n新,闻\n".encode("gb18030"),
        "2026-06-02": b"title,content\ra,b\rc,d\r",
        "2026-06-03": b'title,content\n"p"q,r\nun"quo"ted,s\n',
        "2026-06-04": b"\ntitle,content\na,b\n",
        "2026-06-05": b'"ti\ntle",content\na,b\n',
        "2026-06-06": b"\xff\xfe\x00\x81",
        "2026-06-07": b'title,content\n"%s",b\n' % (b"x" * 200_000) + b'"a" ,b\n',
    }
    for day, content in odd.items():
        written(tmp_path, day, content)
    written(tmp_path, "2026-06-09", b"title,content\nplain,b\n")
    paths = [p for p, *_ in csv_drops.drop_files(spark, str(tmp_path), NEWS)]
    kept = csv_drops.profile(spark, paths)
    assert {n for n, h in kept.items() if h is None} == {f"articles-{day}.csv" for day in odd} and kept["articles-2026-06-09.csv"] == ("title", "content")
    got = csv_drops.read_source(spark, str(tmp_path), NEWS)
    assert shown(got) == shown(by_python(spark, tmp_path))
    assert ("新", "闻") in [r[1:3] for r in shown(got)] and ("plain", "b") in [r[1:3] for r in shown(got)]
    assert max(len(r[1]) for r in shown(got)) == 200_000


def test_random_files_are_read_alike(spark, tmp_path):
    rng = random.Random(5)
    pieces = ("a", "Wort", "新闻", " ", ",", '"', "\n", "\r\n", "é", "#", "\\", "'", "\t", "0", ";", "  x")
    names = ("title", "Title", "content", "body", "authors", "URL", "url", "other", "")
    for day in range(1, 29):
        out = io.StringIO(newline="")
        sheet = csv.writer(out, lineterminator=rng.choice(("\n", "\r\n")), quoting=rng.choice((csv.QUOTE_MINIMAL, csv.QUOTE_ALL)))
        header = [rng.choice(names) for _ in range(rng.randint(1, 6))]
        sheet.writerow(header)
        for _ in range(rng.randint(0, 40)):
            sheet.writerow(["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(max(1, len(header) + rng.randint(-2, 2)))])
        written(tmp_path, f"2026-05-{day:02d}", out.getvalue().encode())
    got = csv_drops.read_source(spark, str(tmp_path), NEWS)
    kept = csv_drops.profile(spark, [p for p, *_ in csv_drops.drop_files(spark, str(tmp_path), NEWS)])
    assert sum(h is not None for h in kept.values()) >= 8
    assert shown(got) == shown(by_python(spark, tmp_path))


def test_an_unquoted_plus_in_a_name(spark, tmp_path):
    written(tmp_path, "2026-05-01 a+b%20", b"title\nx\n")
    row = csv_drops.read_source(spark, str(tmp_path), replace(NEWS, patterns=("articles-",))).first()
    assert row["file_name"] == "articles-2026-05-01 a+b%20.csv" and row["title"] == "x"


def test_order_of_rows_and_no_files(spark, tmp_path):
    written(tmp_path, "2026-05-01", b"title\n" + b"".join(b"%d\n" % k for k in range(5000)))
    rows = csv_drops.read_sources(spark, {NEWS.name: str(tmp_path)}).orderBy("ingest_ord")
    assert [int(r["title"]) for r in rows.collect()] == list(range(5000))
    assert csv_drops.read_source(spark, str(tmp_path), NEWS, months=["2026-04"]).count() == 0
    assert rows.select(F.count_distinct("ingest_ord")).first()[0] == 5000
