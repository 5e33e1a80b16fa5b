"""Archives written and read back, against a plain grouping; damaged archives; heads with odd contents."""

import glob
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from monthwise.llm import warc

PAGES = "page_id long, url string, html string, extra string, digest string, `first` string"


def plain(rows):
    """(page_id, bytes, digest, type, refers_to) by a dictionary of payloads."""
    first = {}
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        if len(payload) >= 100:
            ids = first.setdefault(payload, [])
            ids.append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        known = [x for x in first.get(payload, []) if x is not None]
        least = min(known) if known else None
        again = least is not None and page_id != least
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def test_pages_come_back(spark, tmp_path):
    rng = random.Random(3)
    bodies = [None, "", "x" * 99, "x" * 100, "é" * 50, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9, "long é😀 " * 200_000, "p" * 5000]
    rows = [(i, f"http://a/{i}", rng.choice(bodies), "e", "d", "f") for i in range(300)]
    rows += [(None, "http://null", "p" * 5000, "e", "d", "f"), (7, None, bodies[7], "e", "d", "f"), (-4, "a b\r\nWARC-Type: x\né", "q" * 200, "e", "d", "f"), (-4, "u", "q" * 200, "e", "d", "f"), (None, "u", "only null" * 20, "e", "d", "f"), (None, "u", "only null" * 20, "e", "d", "f")]
    table = spark.createDataFrame(rows, PAGES).repartition(5)
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op13_warc(spark, str(tmp_path)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows)
    warc.write_archives(table, f"{tmp_path}/arch")
    texts = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, f"{tmp_path}/arch", keep=True).where("record_type = 'response' and problem is null").collect()}
    bodies_of = {f"urn:page:{i}": (h or "").encode() for i, _, h, *_ in rows if i is not None and i != 7}
    assert all(bodies_of[k] == v for k, v in texts.items() if k in bodies_of) and len(texts) > 20


def test_an_archive_is_a_sequence_of_members(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("page_id"), F.lit("http://u").alias("url"), F.repeat(F.col("id").cast("string"), 200).alias("html")).write.parquet(f"{tmp_path}/p")
    warc.write_archives(spark.read.parquet(f"{tmp_path}/p"), f"{tmp_path}/a")
    paths = glob.glob(f"{tmp_path}/a/part-*")
    data = b"".join(open(path, "rb").read() for path in paths)
    members, rest = [], data
    while rest:
        one = zlib.decompressobj(31)
        members.append(one.decompress(rest))
        assert one.eof
        rest = one.unused_data
    assert len(members) == 50 + len(paths) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    assert b"".join(members) == gzip.decompress(data)


def test_damage_is_told_and_reading_goes_on():
    good = [warc.record(i, "u", bytes([65 + i]) * 300_000, None) for i in range(4)]
    whole = list(warc.read_records(b"".join(good), keep=True))
    assert [r["problem"] for r in whole] == [None] * 4 and whole[2]["payload"] == b"C" * 300_000
    flipped = bytearray(b"".join(good))
    flipped[len(good[0]) + len(good[1]) // 2] ^= 0x10
    seen = list(warc.read_records(bytes(flipped)))
    assert seen[0]["problem"] is None and seen[1]["problem"] and [r["record_id"] for r in seen[-2:]] == ["urn:page:2", "urn:page:3"]
    assert [r["problem"] for r in seen[-2:]] == [None, None]
    cut = list(warc.read_records(b"".join(good)[:-20]))
    assert cut[-1]["problem"] and [r["problem"] for r in cut[:3]] == [None] * 3
    assert [r["problem"] for r in warc.read_records(b"no archive")] and not list(warc.read_records(b""))


@pytest.mark.parametrize("old, new, problem", [(b"aaaa", b"aaab", "block"), (b"\r\n\r\n\r\n", b"\r\n\r\n", ""), (b"Content-Length: 4", b"Content-Length: 3", "")])
def test_digests_and_lengths_are_held(old, new, problem):
    plain_record = zlib.decompress(warc.record(1, "u", b"aaaa", None), 31)
    seen = list(warc.read_records(warc._member(plain_record.replace(old, new)) if old in plain_record else warc._member(plain_record[:-2])))
    assert seen[0]["problem"] and problem in seen[0]["problem"]


def test_a_revisit_needs_its_response(spark):
    rows = [("urn:page:1", "response", None, 4, "d", None), ("urn:page:2", "revisit", "urn:page:1", 4, "d", None), ("urn:page:3", "revisit", "urn:page:9", 4, "d", None), ("urn:page:4", "revisit", "urn:page:1", 5, "d", None)]
    table = spark.createDataFrame(rows, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, problem string")
    assert {r.record_id: r.problem for r in warc.resolved(table).collect()} == {"urn:page:1": None, "urn:page:2": None, "urn:page:3": "no such response", "urn:page:4": "no such response"}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op13_warc(spark, str(tmp_path)).count() == 0
