"""Operator 10, WARC: writes captures as WARC records and assembles them again.

Method: transaction assembly. A capture is three records: a request, a response (or a revisit of another response with
the same payload) and metadata; the first and the last name the second in WARC-Concurrent-To. Reading takes the records
from all archives as rows, joins the three kinds through these identifiers and gives one nested row for each capture; a
revisit finds its payload's figures through WARC-Refers-To.

Archives are gzip with a member for each record, written to the shared folder by the tasks; a committed table names the
files of finished tasks, so attempts that fail leave nothing that is read.

A record's identifier comes from what it holds (page_id, url, payload, and a number among rows equal in all three), so that
it is the same whenever a task runs again. Payloads go to the tasks that write them once each, pre-aggregated; revisits are
written from narrow rows, and keys that many rows share are salted.

A null html or url is empty. Of rows with equal payloads that with the largest page_id (then the largest url) is the
response, all others revisit it; a null page_id is smaller than any other. Repeated rows are captures of their own. An empty
table writes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, new_path, partitions, salted_join, written
from .files import Rolling, at

#: Least payload bytes of which a repeat becomes a revisit.
LEAST = 0
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 16 << 10
FILES = "file string, bytes long, members long"
RECORDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, page_id long, payload_bytes long, payload_digest string, declared_digest string, payload binary"


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top,
             row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, coalesce(url, '') DESC) = 1 AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', h[i]) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(bits[5 * i + j + 1] AS INTEGER) * (1 << (4 - j)))) AS INTEGER)]), '') AS payload_digest,
       CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first THEN NULL ELSE top END AS refers_to, coalesce(url, '') AS target_uri, TRUE AS digest_matches
FROM b
"""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, content_type: str, block: bytes, *more: tuple[str, str]) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", *(f"{k}: {v}" for k, v in more), f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def capture_id(key: str, part: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{part} {key}'.encode(), usedforsecurity=False).digest())}"


def line(value: str) -> str:
    """A header's value: line ends would end the header."""
    return " ".join(value.split()) if "\n" in value or "\r" in value else value


def capture(page_id: int | None, url: str, html: bytes | None, sha: str, key: str, top: str) -> Iterator[bytes]:
    """The records of one row. html: the payload, null in a revisit, whose sha is its digest in hexadecimal; top: the key of the response that is revisited."""
    own, uri = capture_id(key, "response"), line(url)
    digest = base32_sha1(html) if html is not None else base64.b32encode(bytes.fromhex(sha)).decode()
    path = uri.split("://", 1)[-1].partition("/")
    yield record("request", capture_id(key, "request"), uri, "application/http; msgtype=request", f"GET /{path[2]} HTTP/1.1\r\nHost: {path[0]}\r\n\r\n".encode(), ("WARC-Concurrent-To", f"<{own}>"))
    answer = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if html is not None:
        yield record("response", own, uri, "application/http; msgtype=response", f"{answer}Content-Length: {len(html)}\r\n\r\n".encode() + html, ("WARC-Payload-Digest", f"sha1:{digest}"))
    else:
        yield record("revisit", own, uri, "application/http; msgtype=response", f"{answer}\r\n".encode(), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{capture_id(top, 'response')}>"))
    yield record("metadata", capture_id(key, "metadata"), uri, "application/warc-fields", f"page_id: {'' if page_id is None else page_id}\r\n".encode(), ("WARC-Concurrent-To", f"<{own}>"))


def write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rolling(folder, ".warc.gz")
        for b in batches:
            for page_id, url, html, sha, key, top in zip(*(b.column(i) for i in range(6)), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else None
                for r in capture(page_id.as_py(), url.as_py(), payload, sha.as_py(), key.as_py(), top.as_py()):
                    out.write(member(r))
                out.member_over()
        done = out.finished()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "members"])

    return run


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as archives; gives the table of their files."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    key = lambda page_id, url, n: F.concat_ws(" ", F.coalesce(F.col(page_id).cast("string"), F.lit("-")), F.xxhash64(url).cast("string"), "sha", F.col(n).cast("string") if isinstance(n, str) else n)
    # a response for each payload: tasks combine their copies before the shuffle
    first = rows.groupBy("sha").agg(F.max(F.struct("page_id", "url", "html")).alias("top")).select("sha", "top.page_id", "top.url", "top.html")
    responses = first.select("page_id", "url", "html", "sha", key("page_id", "url", F.lit("0")).alias("key"), F.lit(None).cast("string").alias("to"))
    # the other rows, without payloads
    narrow = written(rows.where(F.octet_length("html") >= LEAST).groupBy("sha", "page_id", "url").agg(F.count("*").alias("n")), "warc-rows", narrow=True)
    top = narrow.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"), F.sum("n").alias("copies")).where("copies > 1")
    # a payload without a copy is its own response and drops out of the inner side before the join
    again = salted_join(narrow, top, "sha", hot_keys(narrow, "sha")).where("copies is not null")
    is_first = F.col("page_id").eqNullSafe(F.col("top.page_id")) & (F.col("url") == F.col("top.url"))
    numbered = again.select("page_id", "url", "sha", F.col("top.page_id").alias("t"), F.col("top.url").alias("u"), F.explode(F.when(~is_first, F.sequence(F.lit(0), F.col("n") - 1)).when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1))).alias("i"))
    revisits = numbered.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", key("page_id", "url", "i").alias("key"), key("t", "u", F.lit("0")).alias("to"))
    return written(responses.unionAll(revisits).mapInArrow(write_archives(new_path(pages.sparkSession, "warc")), FILES), "warc-files")


def members(uri: str) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    files, path = at(uri)
    with files.open_input_stream(path) as f:
        data, unzip, parts = b"", zlib.decompressobj(31), []
        while data or (data := f.read(READ)):
            parts.append(unzip.decompress(data))
            data = unzip.unused_data
            if unzip.eof:
                yield b"".join(parts)
                unzip, parts = zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read_records(with_payload: bool):
    def row(raw: bytes) -> tuple:
        f, block = parse(raw)
        kind, page_id, size, digest, payload = f["warc-type"], None, None, None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, digest = len(payload), base32_sha1(payload)
        elif kind == "metadata":
            value = block.partition(b":")[2].strip()
            page_id = int(value) if value else None
        return bare(f["warc-record-id"]), kind, bare(f.get("warc-concurrent-to")), bare(f.get("warc-refers-to")), f.get("warc-target-uri"), f.get("warc-date"), page_id, size, digest, f.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload if with_payload else None

    kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                held, size = [], 0
                for raw in members(uri):
                    held.append(row(raw))
                    size += len(raw)
                    if len(held) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


def captures(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row for each capture of the archives in files (file, ...): capture_id, request, response, metadata.

    response has its type, digests, payload_bytes, refers_to (a record) and, if with_payload, payload; those of a revisit are its target's."""
    n = partitions(files.sparkSession)
    records = written(files.select("file").repartition(n, "file").mapInArrow(read_records(with_payload), RECORDS), "warc-records")
    named = F.struct("record_id", "target_uri", "date")
    requests = records.where("type = 'request'").select(F.col("concurrent_to").alias("id"), named.alias("request"))
    notes = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("record_id", "target_uri", "date", "page_id").alias("metadata"))
    own = records.where("type in ('response', 'revisit')")
    kept = own.select(F.col("record_id").alias("id"), "type", "target_uri", "date", "refers_to", "declared_digest", "payload_bytes", "payload_digest", "payload")
    whole = kept.join(requests, "id", "left").join(notes, "id", "left")
    # a response is its own target: no null keys, which would all meet in one partition
    whole = whole.withColumn("target", F.coalesce("refers_to", "id"))
    figures = [F.col("payload_bytes").alias("t_bytes"), F.col("payload_digest").alias("t_digest"), F.col("payload").alias("t_payload")]
    targets = kept.where("type = 'response'").select("id", *figures).join(notes, "id", "left").select(F.col("id").alias("target"), F.col("metadata.page_id").alias("t_of"), "t_bytes", "t_digest", "t_payload")
    hot = hot_keys(own.select(F.coalesce("refers_to", "record_id").alias("target")), "target")
    out = salted_join(whole, targets, "target", hot).withColumn("t_page", F.when(F.col("type") == "revisit", F.col("t_of")))
    response = F.struct(
        F.col("id").alias("record_id"), "type", "target_uri", "date", "refers_to", F.col("t_page").alias("refers_to_page"), "declared_digest",
        F.coalesce("payload_bytes", "t_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "t_digest").alias("payload_digest"), F.coalesce("payload", "t_payload").alias("payload"),
    )
    return out.select(F.col("id").alias("capture_id"), "request", response.alias("response"), "metadata")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures(archive(spark.read.parquet(f"{sf_dir}/pages.parquet")), with_payload=False)
    return found.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.col("response.refers_to_page").alias("refers_to"), F.col("request.target_uri").alias("target_uri"), (F.col("response.payload_digest") == F.col("response.declared_digest")).alias("digest_matches"))
