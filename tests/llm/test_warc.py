"""Archives: what is written comes back, and what is broken is told."""

import base64
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from cuesheet.llm import warc


def read(spark, *contents):
    df = spark.createDataFrame([(f"f{k}", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary")
    return warc.read(df).orderBy("path", "record").collect()


def page(k, payload):
    return warc.record(f"urn:x-page:{k}", f"http://h/{k}", payload)


def test_round_trip(spark):
    rng = random.Random(1)
    html = [None, "", "<p>x</p>", "<p>x</p>", "é\x00\r\n\r\nWARC/1.1", "y" * 300_000] + [f"<html>{rng.random()}</html>" * 20 for _ in range(300)]
    html += [html[10]] * 7
    rows = [(k, f"http://h/{k}\r\nX: y" if k % 5 else None, h, "z") for k, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.round_trip(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    first = {}
    for k, _, h, _ in rows:
        first.setdefault(h or "", k)
    for k, _, h, _ in rows:
        data = (h or "").encode()
        r = got[k]
        assert r["error"] is None and r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        low = first[h or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if low == k else ("revisit", low))


def test_odd_rows(spark):
    rows = [(None, "u", "same"), (5, "u", "same"), (5, "u", "same"), (6, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted(
        [(None, "revisit", 5), (5, "response", None), (5, "response", None), (6, "revisit", 5), (None, "response", None)], key=str
    )
    assert warc.round_trip(df.limit(0)).count() == 0


def dictionary():
    samples = [f"WARC/1.1\r\nWARC-Type: response\r\nhtml page number {k} {'abc' * (k % 50)}".encode() for k in range(2000)]
    return zstandard.train_dictionary(4096, samples).as_bytes()


def test_layout_and_dictionary(spark):
    data = dictionary()
    records = [page(k, f"payload {k}".encode() * k) for k in range(20)]
    content = warc.archive(records, data)
    assert struct.unpack("<II", content[:8]) == (warc.SKIPPABLE_DICTIONARY, len(data)) and content[8 : 8 + len(data)] == data
    found = list(warc.frames(memoryview(content)))
    assert len(found) == 21
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    for (_, frame), original in zip(found[1:], records):
        assert decompressor.decompress(bytes(frame)) == original
    assert [bytes(r["payload"]) for r in read(spark, content)] == [f"payload {k}".encode() * k for k in range(20)]
    # The dictionary may itself be a compressed frame.
    packed = zstandard.ZstdCompressor().compress(data)
    again = warc.dictionary_frame(packed) + content[8 + len(data) :]
    assert [r["error"] for r in read(spark, again)] == [None] * 20
    # Without it, frames cannot be decoded.
    assert all(r["error"].startswith("bad frame") for r in read(spark, content[8 + len(data) :]))


def test_frames_of_other_writers(spark):
    """Several blocks, run-length blocks, frames without size or checksum, and skippable frames in between."""
    payload = random.Random(2).randbytes(400_000) + b"0" * 400_000
    plain = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=False)
    content = plain.compress(page(1, payload)) + struct.pack("<II", 0x184D2A51, 3) + b"abc" + plain.compress(page(2, b"0" * 300_000))
    got = read(spark, content)
    assert [(r["error"], r["payload_bytes"]) for r in got] == [(None, 800_000), (None, 300_000)]


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WRAC/1.1"), "no WARC header"),
        (lambda r: r.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""), "no warc-date"),
        (lambda r: r.replace(b"WARC-Type", b"WARC-Tpye"), "no warc-type"),
        (lambda r: r[:-1], "the block's length is not the content-length"),
        (lambda r: r + b"x", "the block's length is not the content-length"),
        (lambda r: r.replace(b"Content-Type: application", b"Content-Type application:"), None),
        (lambda r: r.replace(b"WARC-Target-URI: http://h/1", b"WARC-Target-URI"), "bad header line"),
        (lambda r: r.replace(b"HTTP/1.1 200 OK\r\nContent-Type", b"HTTP/1.1 200 OK\r\nXontent-Type"), None),
        (lambda r: r.replace(b"Content-Length: 7\r", b"Content-Length: 8\r"), "the payload's length is not the HTTP length"),
        (lambda r: r.replace(b"payload", b"pAyload"), "the payload's digest differs"),
    ],
)
def test_broken_records(spark, change, error):
    good, bad = page(0, b"other"), change(page(1, b"payload"))
    got = read(spark, warc.archive([good, bad, good]))
    assert [r["error"] for r in got] == [None, error, None]


def test_broken_files(spark):
    content = warc.archive([page(k, b"x" * 100) for k in range(3)])
    got = read(spark, b"", content[:-5], b"no archive at all", content[:3])
    by = {}
    for r in got:
        by.setdefault(r["path"], []).append(r["error"])
    assert by == {"f1": [None, None, "a frame is cut off"], "f2": ["not a Zstandard frame"], "f3": ["a frame is cut off"]}


def test_binary_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"a{k}.warc.zst").write_bytes(warc.archive([page(k, b"x%d" % k)], dictionary()))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(bytes(r["payload"]) for r in warc.read(files).collect()) == [b"x0", b"x1", b"x2"]


def test_hot_payloads(spark):
    """A third of all pages equal, and one row repeated: the same rows as by hand, and not in one task."""
    rows = [(k, "u", "blocked" if k % 3 == 0 else f"page {k}") for k in range(9_000, 0, -1)] + [(7, "u", "page 7")] * 50
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    want = [(k, "revisit", 3) if k % 3 == 0 and k > 3 else (k, "response", None) for k, _, _ in rows]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    moved = warc.with_revisits(pages).groupBy(F.spark_partition_id().alias("p")).agg(F.sum((F.col("payload") == F.lit(b"blocked")).cast("int")).alias("n"))
    assert max(r.n for r in moved.collect()) < 1_000


def test_dictionary_does_not_depend_on_the_order_of_rows(spark):
    rows = [(k, f"<html><body>page {k % 97} of {k}</body></html>" * 5) for k in range(3_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert warc.train(pages.repartition(7)) == warc.train(pages.orderBy("html").coalesce(1)) != b""
