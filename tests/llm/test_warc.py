import base64
import gzip
import hashlib

import pytest

from signalbase.llm import warc

ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "http://c x\r\ny", "é" * 50_000), (None, "n", "same"), (None, "n", "alone"), (2, "http://b", "same")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    frame = spark.createDataFrame([(*r, 0) for r in ROWS], "page_id long, url string, html string, refers_to long")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(frame).collect()), key=repr)
    largest = {}
    for i, _, h in ROWS:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    wanted = []
    for i, _, h in ROWS:
        top = largest[h or ""]
        first = top == -1 or i == top
        wanted.append((i, len((h or "").encode()), digest(h), "response" if first else "revisit", None if first else top))
    assert got == sorted(wanted, key=repr)


def test_small_payloads_are_no_revisits(spark):
    frame = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/warc-test-small"
    report = warc.write_warc(frame, folder, min_revisit_bytes=5, archive_bytes=1)
    assert report.count() == 2
    assert {r["record_type"] for r in warc.read_warc(spark, folder, report).collect()} == {"response"}


def test_files_that_no_report_names_are_not_read(spark, tmp_path):
    frame = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string")
    report = warc.write_warc(frame, f"file://{tmp_path}/w")
    (tmp_path / "w" / "left-over.warc.gz").write_bytes(b"half a file")
    assert warc.read_warc(spark, f"file://{tmp_path}/w", report).count() == 2


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_members_are_framed_one_by_one():
    members = [warc.record(1, "u", b"x" * 200_000), warc.record(2, "u", b"y", refers_to=1)]
    for chunk in (1, 7, 1 << 16):
        got = [warc.described(*r) for r in warc.records(b"".join(members), chunk)]
        assert [(g[0], g[1], g[3], g[4]) for g in got] == [(1, 200_000, "response", None), (2, 1, "revisit", 1)]
    assert gzip.decompress(members[1]).startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n")


def test_broken_archives():
    good = warc.record(1, "u", b"payload")
    with pytest.raises(ValueError):
        list(warc.records(good[:-9]))
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(gzip.decompress(good).replace(b"payload", b"pay1oad"))))
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(b"no record")))
