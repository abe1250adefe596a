"""WARC archives: an index of offset, length, URL and digest first, then reads of only the byte ranges that are asked for.

``archive`` writes a gzip member for each page to archives in a folder that all executors share, and returns their index, a row for each record.  Pages
of equal payloads are told by a count of their SHA-256: the largest id's record is a response, the others are revisits that name it and hold its
HTTP head alone.  ``read`` takes any rows of an index, range-partitions them by archive and offset, merges ranges that lie near each other
into one read, and checks each record against its digest and length.

A task names its archives afresh, and only the index of a task that Spark commits is read, so files that a lost or repeated task leaves are
never seen.  Archives are reached through ``pyarrow.fs``, by the URI of the shared folder.

A null payload counts as empty.  A null id is smaller than any; of equal payloads all rows that share the largest id are responses.
A null URL is written as ``about:blank`` and null in the index.  Payloads are written whole, however long, one at a time.  An empty
table gives an empty index.  Only the three columns named are read, so others may have any name.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, delete_at_exit, give_back, shared_dir, sliced, staged, table

#: Bytes after which a task goes on to a new archive.
ROLL = 1 << 30
#: Bytes between two records that are read rather than skipped, bytes of a read, and bytes of records that a task reads, or thereabouts.
GAP, READ, TASK = 64 << 10, 8 << 20, 16 << 20
#: Keys that the copies of one payload are spread over.
SALTS = 32
_URL_SAFE = "".join(map(chr, range(0x21, 0x7F)))
_INDEX = "archive string, offset long, length long, record_type string, page_id long, url string, payload_digest string"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's file systems resolve it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def _digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}/sha1:{digest}')}>"


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))]) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def record(page, url: str | None, payload: bytes, response, revisit: bool, date: str) -> tuple[bytes, str]:
    """A page's record, and its digest: a response, or a revisit of the ``response`` page's."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", "about:blank" if url is None else quote(url, safe=_URL_SAFE)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if page is None else page),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(response, digest)), ("X-Refers-To-Page", response)]
    return _member(fields, http if revisit else http + payload), digest


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record's gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:size]


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """(page, url, payload, response): ``response`` is the page that equal payloads refer to, null where a payload is alone.

    Copies are counted by digest, without their payloads; the copies of one payload meet what was counted under SALTS keys.
    """
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), text.alias("payload"), key.alias("key"))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("key").agg(F.count("*").alias("n"), F.max("page").alias("response")).where("n > 1")
    shared = staged(shared.select("key", "response"), "op12-shared").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(shared.withColumn("copies", F.lit(True)).hint("shuffle_hash"), ["key", "salt"], "left").select("page", "url", "payload", "response", F.coalesce("copies", F.lit(False)).alias("copies"))


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write archives of all rows below ``path`` and return their index, which lies there too.  Payloads of fewer than ``least`` bytes are responses always."""
    spark = pages.sparkSession
    bounded_batches(spark)
    to = _uri(spark, path) + "/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, n = None, "", 0, 0
        stem = f"{to}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        try:
            for batch in sliced(batches, "payload", 1 << 20):
                rows = []
                for page, url, text, response, copies in zip(*[batch.column(c).to_pylist() for c in ("page", "url", "payload", "response", "copies")], strict=True):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, n = f"{stem}-{n:04d}.warc.gz", n + 1
                        fs, file = FileSystem.from_uri(name)
                        fs.create_dir(file.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(file, compression=None)
                        at = out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    revisit = copies and page != response
                    member, digest = record(page, url, text.encode(), response, revisit, date)
                    out.write(member)
                    rows.append((name, at, len(member), "revisit" if revisit else "response", page, url, digest))
                    at += len(member)
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()
        give_back()

    with_roles(pages, id_col, url_col, payload_col, least).mapInArrow(run, _INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def _ranges(places: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of places, ordered by archive and offset, that one read each fetches."""
    first = 0
    for k in range(1, len(places) + 1):
        if k < len(places):
            (a, x, n), (b, y, m) = places[k - 1], places[k]
            if a == b and y - (x + n) <= GAP and y + m - places[first][1] <= READ:
                continue
        yield first, k
        first = k


def read(index: DataFrame, payload: bool = False) -> DataFrame:
    """The records at the places that ``index`` names: (page_id, payload_bytes, payload_digest, record_type, refers_to[, url, payload]).

    A revisit's length and digest are those of the payload that it stands for; its own ``payload`` is null.
    """
    bounded_batches(index.sparkSession)
    schema = _RECORD + ", url string, payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, ""
        for batch in sliced(batches, rows=1 << 14):
            places = list(zip(*[batch.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True))
            for i, j in _ranges(places):
                if opened != places[i][0]:
                    fs, path = FileSystem.from_uri(opened := places[i][0])
                    file = fs.open_input_file(path)
                low = places[i][1]
                data, rows = file.read_at(places[j - 1][1] + places[j - 1][2] - low, low), []
                for _, offset, length in places[i:j]:
                    fields, block = parsed(data[offset - low : offset - low + length])
                    head, _, body = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length:")[2])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(body) != size or _digest(body) != digest):
                        raise ValueError(f"a record of {opened} at {offset} isn't what its digest says")
                    number = lambda k, f=fields: int(f[k]) if f.get(k) else None
                    rows.append((number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page"), fields["WARC-Target-URI"], body if kind == "response" else None)[: len(names)])
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        give_back()

    order = "archive", "offset"
    parts = (index.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0) // TASK + 1  # index rows are small: left to their size, one task would read them all
    return index.select(*order, "length").repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/vecloom/op12-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return read(archive(table(spark, sf_dir, "pages"), path))


ORACLE = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, payload, sha1(payload) AS hex, strlen(payload)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS response FROM rows),
coded AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1)), '') AS payload_digest FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM coded"""
