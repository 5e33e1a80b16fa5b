"""WARC archives of pages: a gzip member per record, written by Spark and read back in sequence.

Writing: payloads are hashed where they are read; only (digest, page_id) is grouped,
and the payloads meet the digests that repeat in a join whose hot digests Spark may
split. Each task compresses its records, one gzip member each, and joins members to
rows of about CHUNK_BYTES. Spark's text writer puts the rows' bytes into files as they
are, so that its commit protocol holds on any storage: a task that runs twice leaves
one archive. What it writes behind each row, its line separator, is the member of a
``warcinfo`` record, so that an archive is a sequence of records and nothing else.

Reading: an archive is one row of the binary reader. A task inflates it in steps of
STEP_BYTES, reads a record's head up to its blank line, takes as many bytes as
Content-Length says, and holds the block and payload to their digests; nothing but the
record at hand is held beside the compressed archive. A record that does not hold is
returned with its ``problem``, and reading goes on at the next member.

Defined results: a null html is an empty payload; a null page_id is kept as such and
comes after all numbers; rows that repeat the smallest page_id of a payload are all
responses; pages without a url have no target; characters that may not stand in a
head (controls, blanks, beyond ASCII) are percent-encoded in targets; other columns are
not carried; an empty table gives no record. Archives are about ARCHIVE_ROWS *
CHUNK_BYTES long, or as long as one page needs.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Payloads of fewer bytes are stored wherever they are found.
LEAST_REVISIT = 100
CHUNK_BYTES, ARCHIVE_ROWS, STEP_BYTES = 1 << 20, 16, 64 << 10
#: The pages have no time of their own, and reruns agree.
WRITTEN = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
_GZIP, _BREAK, _END = b"\x1f\x8b\x08", b"\r\n", b"\r\n\r\n"

RECORD = "offset long, record_id string, record_type string, target string, written string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def _member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def _head(fields: dict[str, str | None]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items() if v is not None) + _BREAK


def _digest(content: bytes) -> str:
    return "sha256:" + hashlib.sha256(content).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """The member of a page; a revisit (``first`` is the page it repeats) has the block's HTTP head alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        block += payload
    fields = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<{ID}{'null' if page_id is None else page_id}>",
        "WARC-Date": WRITTEN,
        "WARC-Target-URI": None if url is None else quote(url, safe="!\"#$%&'()*+,/:;<=>?@[\\]^`{|}~"),
        "WARC-Payload-Digest": _digest(payload),
        "WARC-Block-Digest": _digest(block),
        "WARC-Profile": None if first is None else PROFILE,
        "WARC-Refers-To": None if first is None else f"<{ID}{first}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return _member(_head(fields) + block + _END)


def _info() -> bytes:
    block = b"software: monthwise\r\nformat: WARC File Format 1.1\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, PROFILE).urn}>", "WARC-Date": WRITTEN, "WARC-Block-Digest": _digest(block), "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}
    return _member(_head(fields) + block + _END)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c for c in batch.columns), strict=True):
            held.append(record(*(x.as_py() for x in row)))
            size += len(held[-1])
            if size >= CHUNK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["chunk"])


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record for each row (page_id, url, html) to gzip archives in ``folder``, which must not exist."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= LEAST_REVISIT, F.unhex(F.sha2("payload", 256))))
    again = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(again, "digest", "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
    chunks = rows.mapInArrow(_packed, "chunk binary").select(F.col("chunk").cast("string"))
    chunks.write.option("encoding", "ISO-8859-1").option("lineSep", _info().decode("latin-1")).option("maxRecordsPerFile", ARCHIVE_ROWS).text(folder)


class _Inflated:
    """The content of the gzip member that begins at ``at``, inflated in steps."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.held, self.member = data, at, b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.member.eof:
            return False
        step = self.member.unconsumed_tail
        if not step:
            step = self.data[self.at : self.at + STEP_BYTES]
            self.at += len(step)
        if not len(step):
            raise ValueError("the archive ends inside a record")
        self.held += self.member.decompress(step, STEP_BYTES)
        if self.member.eof:
            self.at -= len(self.member.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        while (found := self.held.find(mark)) < 0:
            if not self._more():
                raise ValueError("a head has no end")
        out, self.held = self.held[:found], self.held[found + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise ValueError("the record ends before its length")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def close(self) -> int:
        """Where the next member begins; nothing but the record's end may be left."""
        while self._more():
            if len(self.held) > len(_END):
                break
        if self.held != _END:
            raise ValueError("the record goes on behind its length")
        return self.at


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _length(fields: dict[str, str]) -> int:
    if not re.fullmatch(r"\d+", value := fields.get("content-length", "")):
        raise ValueError("a head without a length")
    return int(value)


def _one(data: memoryview, at: int, keep: bool) -> tuple[dict, int]:
    """The record at ``at``, and where the next one begins."""
    member = _Inflated(data, at)
    head = member.until(_END)
    if not head.startswith(b"WARC/"):
        raise ValueError("no record begins here")
    fields = _fields(head)
    left, kind = _length(fields), fields.get("warc-type")
    block, payload, kept, size, http = hashlib.sha256(), hashlib.sha256(), [], 0, None
    opening = b"" if fields.get("content-type", "").startswith("application/http") else None
    for part in member.take(left):
        block.update(part)
        if opening is not None:
            opening += part
            end = opening.find(_END)
            if end < 0:
                continue
            http, part, opening = _fields(opening[:end]), opening[end + len(_END) :], None
        payload.update(part)
        size += len(part)
        if keep:
            kept.append(part)
    after = member.close()
    told, problem = fields.get("warc-payload-digest"), None
    if fields.get("warc-block-digest", "sha256:" + block.hexdigest()) != "sha256:" + block.hexdigest():
        problem = "the block is not that of its digest"
    elif kind == "response" and told is not None and told != "sha256:" + payload.hexdigest():
        problem = "the payload is not that of its digest"
    elif kind == "response" and http and "content-length" in http and _length(http) != size:
        problem = "the payload is not as long as its head says"
    if kind == "revisit":
        size = _length(http or {})
    else:
        told = "sha256:" + payload.hexdigest()
    row = {"offset": at, "record_id": fields.get("warc-record-id", "").strip("<>") or None, "record_type": kind, "target": fields.get("warc-target-uri"), "written": fields.get("warc-date")}
    row |= {"refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "payload_bytes": size, "payload_digest": (told or "").removeprefix("sha256:") or None}
    return row | {"payload": b"".join(kept) if keep and kind != "revisit" else None, "problem": problem}, after


def _next_member(data: memoryview, at: int) -> int:
    """Where the next member with a record begins, or the end."""
    for found in re.finditer(re.escape(_GZIP), data[at:]):
        begin = at + found.start()
        try:
            if zlib.decompressobj(31).decompress(data[begin : begin + STEP_BYTES], 5) == b"WARC/":
                return begin
        except zlib.error:
            pass
    return len(data)


def read_records(data: bytes | memoryview, keep: bool = False) -> Iterator[dict]:
    """The records of an archive in sequence; with ``keep`` their payloads too."""
    data, at = memoryview(data), 0
    while at < len(data):
        try:
            row, at = _one(data, at, keep)
        except (ValueError, zlib.error) as e:
            row, at = {"offset": at, "problem": str(e)}, _next_member(data, at + 1)
        yield row


def read_archives(spark: SparkSession, folder: str, keep: bool = False) -> DataFrame:
    """path and RECORD of every record of the archives in ``folder``; payloads are null without ``keep``."""
    schema = f"path string, {RECORD}"
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.binary() if n == "payload" else pa.int64() if n in ("offset", "payload_bytes") else pa.string() for n in names]

    def read(batches):
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for row in read_records(memoryview(content.as_buffer()), keep):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) == 4096 or size > CHUNK_BYTES:
                        yield _batch(path.as_py(), rows, names, types)
                        rows, size = [], 0
                if rows:
                    yield _batch(path.as_py(), rows, names, types)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(read, schema)


def _batch(path: str, rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True))], ["path", *names])


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with a problem at each revisit whose response is not there with the same digest and length."""
    stored = records.where("record_type = 'response' and problem is null").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("stored")).distinct()
    others = records.where("not (record_type <=> 'revisit')")
    revisits = records.where("record_type = 'revisit'").join(stored, ["refers_to", "payload_digest", "payload_bytes"], "left")
    revisits = revisits.withColumn("problem", F.coalesce("problem", F.when(F.col("stored").isNull(), "no such response"))).drop("stored")
    return others.unionByName(revisits)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{store.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    rows = resolved(store.cut(read_archives(spark, folder).drop("payload"))).where("not (record_type <=> 'warcinfo')")  # the archives are read once
    page = lambda c: F.try_to_number(F.substr(c, F.lit(len(ID) + 1)), F.lit("S9999999999999999999")).cast("long")
    return rows.select(
        page(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("an archive does not hold: "), F.col("problem")))).alias("record_type"),
        page(F.col("refers_to")).alias("refers_to"),
    )


OP13_SQL = f"""
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS f FROM rows WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN f IS NULL OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM rows LEFT JOIN firsts USING (payload_digest)
"""
