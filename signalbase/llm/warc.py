"""WARC archives: write pages as records, and a sequential reader.

Each record is a gzip member of its own. The reader inflates member after
member, frames records by their content length and verifies block and
payload digests. Archives roll over at ``ARCHIVE_BYTES``, so that a task
holds one of bounded size.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with
the largest id is written as a response; the others are revisits, without the
payload, that refer to it. Tasks write archives under fresh names into a
shared folder and report them; the report, committed by Spark, says which
archives count, so files that a lost or repeated task has left are not read.

Defined cases: a null payload is empty; a null URL is an empty target; rows
that repeat with the largest id are responses, each; a record whose id is
null revisits like any other, and where all ids of a payload are null all its
records are responses; an empty table gives an empty result. A record that
does not verify raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase.llm.common import by_size, shared_dir, staged

ARCHIVE_BYTES = 16_000_000
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:signalbase:page")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member: a response, or a revisit of ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, str(page_id)) if page_id is not None else uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, str(refers_to))}>", f"Refers-To-Page-Id: {refers_to}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def records(archive: bytes | memoryview, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, member by member; ``chunk`` compressed bytes are inflated at a time."""
    data, at = memoryview(archive), 0
    while at < len(data):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("the last member is cut off")
            piece = data[at : at + chunk]
            parts.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        raw = b"".join(parts)
        end = raw.find(b"\r\n\r\n")
        first, *lines = raw[:end].decode().split("\r\n")
        if end < 0 or not first.startswith("WARC/1."):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = raw[end + 4 : end + 4 + int(headers["Content-Length"])]
        if raw[end + 4 + len(block) :] != b"\r\n\r\n" or "sha1:" + payload_digest(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} does not verify")
        yield headers, block


def described(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {headers.get('WARC-Record-ID')} does not verify")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("Page-Id"), length, digest, kind, number("Refers-To-Page-Id")


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives below ``folder`` (a URI that driver and executors share); returns (archive, n_records, n_bytes), committed."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= min_revisit_bytes, F.sha1("html")))
    # A third of all payloads may be one: the largest id is taken by a partial aggregate, and the join can be split.
    largest = df.select(F.col(id_col).cast("long").alias("id"), F.sha1(body).alias("digest")).groupBy("digest").agg(F.max("id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(largest, "digest", "left").select("id", "url", "html", F.when(F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        out, done = None, []

        def close() -> None:
            out.close()
            done.append((name, n, size))

        for batch in by_size(batches):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "n_records", "n_bytes"])

    return staged(rows.mapInArrow(write, "archive string, n_records bigint, n_bytes bigint"), "warc-report")


def read_warc(spark: SparkSession, folder: str, report: DataFrame) -> DataFrame:
    """A row for each record of the archives in ``report``: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(report.select("archive"), "archive", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        for batch in batches:
            for archive in batch.column(0):
                found = [described(*r) for r in records(archive.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(zip(*found), kinds)], [name for name, _ in kinds])

    return files.select("content").mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(df: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/signalbase/warc-{uuid.uuid4().hex}"
    report = write_warc(df, folder)
    if report.isEmpty():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_warc(spark, folder, report)


#: DuckDB SQL of the query op8. Base32: each 5 hex digits of the digest are 4 characters.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * c}) & 31 AS INTEGER) + 1, 1)" for g in range(8) for c in range(4)
)
ORACLE = f"""
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
    CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS m FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""
