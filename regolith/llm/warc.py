"""WARC archives as a chunked record table.

A record is written as rows (part, chunk_no, ...) of at most CHUNK characters of payload, so that neither writer nor
reader holds a whole record's bytes. Each row carries a gzip member and the payload's SHA-1 up to its end; the members of
a record in order are that record of a .warc.gz file. The table is Parquet in the shared folder, written by Spark's
committer, so lost executors leave no half archive.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is the response, the others
are revisits without a body that refer to it; smaller payloads are all responses. Equality is decided by SHA-256.

Reading back: a record of one chunk is parsed where it lies; those of several are dealt by record, sorted by chunk and
streamed through a state machine that checks lengths and running digests. One record's digest is sequential by nature.

Cases: null html is an empty payload; null page_ids are smaller than any other and refer to none; rows that share
payload and the largest page_id are all responses; control characters in urls are percent-encoded; an empty table gives
an empty archive; further columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import if_small, in_batches, written

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture

TABLE = "part bigint, chunk_no int, last boolean, page_id bigint, data binary, digest_so_far string"
_ARROW = pa.schema([("part", pa.int64()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("page_id", pa.int64()), ("data", pa.binary()), ("digest_so_far", pa.string())])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, n_bytes, sha1, record_type, refers_to of each page.

    Which pages revisit others is decided on narrow rows, and only payloads that occur more than once have a decision. It
    comes back by broadcast where such payloads are counted to be few; beyond, by a join that Spark splits where it is skewed.
    """
    own = pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    own = own.withColumn("n_bytes", F.octet_length("html").cast("bigint")).withColumn("same", F.unhex(F.sha2("html", 256)))
    again = own.filter(F.col("n_bytes") >= least).groupBy(F.col("same").alias("of")).agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    again = written(again.filter("n > 1 and latest is not null").drop("n"), "repeated")
    both = own.join(if_small(again), F.col("same") == F.col("of"), "left")
    revisit = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return both.select("page_id", "url", "html", "n_bytes", F.sha1("html").alias("sha1"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("latest")).alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _head(page_id, url, n_bytes, digest, record_type, refers_to) -> bytes:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {n_bytes if record_type == 'response' else 0}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"


def record_chunks(page_id, url, html, n_bytes, sha1, record_type, refers_to) -> Iterator[tuple]:
    """(chunk_no, last, bytes, digest so far) of one record."""
    digest, body = base32(bytes.fromhex(sha1)), html if record_type == "response" else ""
    running, parts = hashlib.sha1(), max(1, -(-len(body) // CHUNK))
    for i in range(parts):
        data = body[i * CHUNK : (i + 1) * CHUNK].encode("utf-8", "surrogatepass")
        running.update(data)
        head = _head(page_id, url, n_bytes, digest, record_type, refers_to) if i == 0 else b""
        yield i, i == parts - 1, head + data + (b"\r\n\r\n" if i == parts - 1 else b""), base32(running.digest())


def write_archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """The chunked record table of all pages, written and opened again."""

    def run(batches):
        def rows():
            part = TaskContext.get().partitionId() << 40
            for b in batches:
                for r in zip(*b.columns):
                    values = [v.as_py() for v in r]
                    for no, last, data, so_far in record_chunks(*values):
                        yield part, no, last, values[0], gzip.compress(data, 1, mtime=0), so_far
                    part += 1

        yield from in_batches(rows(), _ARROW, lambda r: len(r[4]) + 64)

    return written(decided(pages, least).mapInArrow(run, TABLE), "warc", "uncompressed")


def read_records(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of chunk rows, the chunks of a record in order."""
    part = None
    for p, no, last, _, data, so_far in rows:
        raw = zlib.decompress(data, 31)
        if no == 0:
            if part is not None:
                raise ValueError("a record ends early")
            at = raw.index(b"\r\n\r\n")
            lines = raw[:at].decode("utf-8", "surrogatepass").split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            part, left, running, raw, expected = p, int(head["Content-Length"]), hashlib.sha1(), raw[at + 4 :], 0
        elif p != part or no != expected:
            raise ValueError("a chunk is missing")
        body, end = raw[:left], raw[left:]
        left -= len(body)
        expected += 1
        running.update(body)
        if base32(running.digest()) != so_far:
            raise ValueError("a chunk's running digest differs")
        if last:
            if left or end != b"\r\n\r\n":
                raise ValueError("a record's length differs")
            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and digest != so_far:
                raise ValueError("a payload's digest differs")
            to = head.get("X-Refers-To-Page-ID")
            yield int(head["X-Page-ID"]) if head["X-Page-ID"] else None, int(head["X-Payload-Length"]), digest, kind, int(to) if to else None
            part = None
        elif end:
            raise ValueError("a record's length differs")
    if part is not None:
        raise ValueError("a record ends early")


def read_archive(table: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of a chunked record table."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        rows = (tuple(v.as_py() for v in r) for b in batches for r in zip(*b.columns))
        yield from in_batches(read_records(rows), schema)

    out = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    whole = (F.col("chunk_no") == 0) & F.col("last")
    short = table.filter(whole).mapInArrow(run, out)
    long = table.filter(~whole).repartition("part").sortWithinPartitions("part", "chunk_no").mapInArrow(run, out)
    return short.unionByName(long)
