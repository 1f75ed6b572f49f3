"""WARC archives: a writer, and a sequential reader.

An archive is the concatenation of gzip members, one per record. The writer
makes archives of about ``ARCHIVE_BYTES`` as rows ``(archive, content)`` of a
table in the shared checkpoint folder; the reader takes such rows, or real files
through ``spark.read.format("binaryFile")`` (its ``path, content``). It inflates
a member piece by piece, takes the header up to the blank line, frames the block
by ``Content-Length``, and checks length and block digest before it yields the
record. A damaged member gives a row with ``error``; reading goes on at the next
gzip header.

Of records with equal payloads of at least ``least`` bytes the one with the
largest page id is the response, and the others revisit it. The largest id comes
from a partial and final maximum per digest, so a payload that a third of all
pages share is no group of its own; the join back to the pages is a skewed join,
which Spark splits.

Defined results: a null payload is empty; a null page id is written without an
id and read back as null (and is never the response of a group, unless all its
ids are null: then all of them stay responses); pages that repeat the largest id
with the same payload are all responses; an empty table gives no archive and an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ARCHIVE_BYTES = 16 << 20
#: Compressed bytes given to the decompressor at a time.
CHUNK = 64 << 10
_GZIP = b"\x1f\x8b\x08"

_RECORD = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
    ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary()), ("error", pa.string())])
RECORD_DDL = ("archive string, offset long, record_type string, page_id long, refers_to long, url string, "
              "payload_bytes long, payload_digest string, payload binary, error string")


def _member(kind: str, page_id, refers_to, url: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """One record as a gzip member."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""),
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
            f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least: int = 1000) -> DataFrame:
    """Stored archives ``(archive, content)`` with a record per page."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn(
        "size", F.octet_length("payload").cast("bigint"))
    shared = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("kept"), F.count("*").alias("n"))
    placed = rows.join(shared.filter("n > 1").select("digest", "kept"), "digest", "left").select(
        "id", "url", "payload", "digest", "size", F.when(F.col("size") >= least, F.col("kept")).alias("kept"))

    def write(batches):
        part, n, members, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for page_id, url, payload, digest, nbytes, kept in zip(*(c.to_pylist() for c in b.columns)):
                revisit = kept is not None and page_id != kept
                members.append(_member("revisit" if revisit else "response", page_id, kept, url, digest, nbytes, payload))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield _archive(part, n, members)
                    n, members, size = n + 1, [], 0
        if members:
            yield _archive(part, n, members)

    return stored(placed.mapInArrow(write, "archive string, content binary"))


def _archive(part: int, n: int, members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:04d}.warc.gz"]), pa.array([b"".join(members)])],
                                      ["archive", "content"])


def members(content: bytes) -> Iterator[tuple[int, bytes | None]]:
    """``(offset, inflated bytes)`` of each gzip member, None for a damaged one."""
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts, fed = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                piece = view[fed:fed + CHUNK]
                if not len(piece):
                    raise zlib.error("the member ends early")
                fed += len(piece)
                parts.append(unpack.decompress(piece))
        except zlib.error:
            yield at, None
            at = content.find(_GZIP, at + 1)
            if at < 0:
                return
            continue
        yield at, b"".join(parts)
        at = fed - len(unpack.unused_data)


def parse(record: bytes) -> dict:
    """Header, payload and checks of one inflated record; raises ValueError."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not blank or not version.startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block does not have its Content-Length")
    block = rest[:size]
    if fields["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("the block does not match its digest")
    kind = fields["warc-type"]
    if kind == "response" and fields["warc-payload-digest"] != fields["warc-block-digest"]:
        raise ValueError("the payload does not match its digest")

    def page(field: str):
        value = fields.get(field, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    return {"record_type": kind, "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to"),
            "url": fields.get("warc-target-uri"), "payload_bytes": int(fields["x-payload-length"]),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "payload": block if kind == "response" else None, "error": None}


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of ``archives`` (``archive`` or ``path``, and ``content``) in order."""
    name = "archive" if "archive" in archives.columns else "path"

    def read(batches):
        for b in batches:
            for archive, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for offset, record in members(content.as_py() or b""):
                    try:
                        if record is None:
                            raise ValueError("damaged gzip member")
                        row = parse(record)
                    except (ValueError, KeyError, UnicodeDecodeError) as e:
                        row = {"error": str(e) or type(e).__name__}
                    rows.append({"archive": archive, "offset": offset} | row)
                    size += len(record or b"")
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return archives.select(name, "content").mapInArrow(read, RECORD_DDL)


def op8_warc(spark, sf_dir):
    from .common import load
    records = read_archives(write_archives(load(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM p LEFT JOIN g USING (d)"""
