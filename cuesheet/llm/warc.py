"""WARC archives in Zstandard: one frame per record, with the dictionary in a leading skippable frame.

An archive is a row (path, content), the layout of Spark's ``binaryFile`` source, so files in any store that Spark
reads can be read with ``spark.read.format("binaryFile")`` and what ``archives`` makes can be kept as a table. An
archive holds at most ``ARCHIVE_BYTES`` of blocks (or one larger record), so rows stay small while their number grows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cuesheet.llm.arrow import slices
from cuesheet.session import stored

ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
DICTIONARY_PAGES = 400  # the dictionary is trained on at most so many pages
DICTIONARY_CHARS = 20_000
HOT_SHARE = 1_000  # a payload is hot if more than one row in so many has it
LEVEL = 3
# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "path string, record int, record_id string, record_type string, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary, error string"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One uncompressed record; with ``refers_to`` a revisit, whose block has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if refers_to is not None else payload)
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT)]
    # A line break in a value would end the header early.
    head = "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in lines)
    return VERSION + b"\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def frames(content: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic number, bytes) of each frame; ends are read from the frames' own block headers."""
    at = 0
    while at < len(content):
        if len(content) - at < 8:
            raise ValueError("a frame is cut off")
        magic = int.from_bytes(content[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            end = at + 8 + int.from_bytes(content[at + 4 : at + 8], "little")
        elif content[at : at + 4] == FRAME:
            flags = content[at + 4]
            end = at + zstandard.frame_header_size(content[at : at + 18])
            last = False
            while not last:
                if end + 3 > len(content):
                    raise ValueError("a frame is cut off")
                block = int.from_bytes(content[end : end + 3], "little")
                last, kind, size = block & 1, (block >> 1) & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)  # a run-length block has one byte
            end += 4 if flags & 4 else 0  # checksum
        else:
            raise ValueError("not a Zstandard frame")
        if end > len(content):
            raise ValueError("a frame is cut off")
        yield magic, content[at:end]
        at = end


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)


def archive(records: list[bytes], dictionary: bytes = b"") -> bytes:
    """The bytes of one archive."""
    compressor = _compressor(dictionary)
    parts = [dictionary_frame(dictionary)] if dictionary else []
    return b"".join(parts + [compressor.compress(r) for r in records])


def parse(data: bytes) -> dict:
    """The fields of one record; an ``error`` says what is wrong with it."""
    found = dict.fromkeys(
        ("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload", "error")
    )
    head, end, block = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not end or not first.startswith(b"WARC/1."):
        return found | {"error": "no WARC header"}
    fields = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            return found | {"error": "bad header line"}
        fields[name.strip().lower()] = value.strip()
    found |= {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
    }
    for name in ("warc-record-id", "warc-type", "warc-date", "content-length"):
        if not fields.get(name):
            return found | {"error": f"no {name}"}
    if not fields["content-length"].isdecimal():
        return found | {"error": "bad content-length"}
    length = int(fields["content-length"])
    if len(block) != length + 4 or block[length:] != b"\r\n\r\n":
        return found | {"error": "the block's length is not the content-length"}
    kind, _, named = fields.get("warc-payload-digest", "").partition(":")
    if found["record_type"] in ("response", "revisit"):
        http, end, payload = block[:length].partition(b"\r\n\r\n")
        sizes = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
        if not end or not sizes or not sizes[0].isdigit():
            return found | {"error": "no HTTP header with a length"}
        found |= {"payload_bytes": int(sizes[0]), "payload_digest": named or None}
        if found["record_type"] == "revisit":
            if payload or not found["refers_to"] or kind != "sha1":
                return found | {"error": "bad revisit record"}
        elif len(payload) != int(sizes[0]):
            return found | {"error": "the payload's length is not the HTTP length"}
        elif kind == "sha1" and digest(payload) != named:
            return found | {"error": "the payload's digest differs"}
        else:
            found["payload"] = payload
    return found


def records(content: bytes) -> Iterator[dict]:
    """All records of an archive; a broken frame is a row with an error, a broken archive ends with one."""
    decompressor = zstandard.ZstdDecompressor()
    number = 0
    try:
        for place, (magic, frame) in enumerate(frames(memoryview(content))):
            if magic == SKIPPABLE_DICTIONARY and place == 0:
                data = bytes(frame[8:])
                if data[:4] == FRAME:  # the dictionary may itself be compressed
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            elif frame[:4] == FRAME:
                try:
                    found = parse(decompressor.decompressobj().decompress(frame))
                except zstandard.ZstdError as problem:
                    found = dict.fromkeys(("error",), f"bad frame: {problem}")
                yield {"record": number} | found
                number += 1
    except ValueError as problem:
        yield {"record": number, "error": str(problem)}


def train(pages: DataFrame, html: str = "html", key: str = "page_id") -> bytes:
    """A dictionary from at most DICTIONARY_PAGES pages, those with the smallest hashes; none if there is too little to
    train on. Of a page its first DICTIONARY_CHARS characters: what a dictionary holds does not change any record read back.
    """
    order = F.xxhash64(key, html)
    share = min(1.0, 4.0 * DICTIONARY_PAGES / max(1, pages.count()))
    # About four times as many rows as are wanted are sorted, however many pages there are.
    some = pages.where((F.length(html) > 0) & (F.pmod(order, F.lit(1 << 30)) / F.lit(float(1 << 30)) < share))
    rows = some.select(F.substring(html, 1, DICTIONARY_CHARS).alias("h"), order.alias("o")).orderBy("o", "h")
    samples = [r["h"].encode("utf-8", "surrogatepass") for r in rows.limit(DICTIONARY_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def archives(pages: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """Archives of ``pages(record_id, uri, payload, refers_to)``: rows (path, content).

    A page with ``refers_to`` becomes a revisit record. A null payload is an empty one, a null uri an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        compressor = _compressor(dictionary)
        lead = dictionary_frame(dictionary) if dictionary else b""
        parts, held, number = [lead], 0, 0

        def close() -> pa.RecordBatch:
            path = f"part-{context.partitionId():05d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

        for part in slices(batches):
            for row in part.to_pylist():
                data = record(row["record_id"], row["uri"] or "", row["payload"] or b"", row["refers_to"])
                if held and held + len(data) > ARCHIVE_BYTES:
                    yield close()
                    parts, held, number = [lead], 0, number + 1
                parts.append(compressor.compress(data))
                held += len(data)
        if held:
            yield close()

    rows = pages.select("record_id", "uri", F.col("payload").cast("binary").alias("payload"), "refers_to")
    return rows.mapInArrow(run, "path string, content binary")


def read(files: DataFrame) -> DataFrame:
    """Records of ``files(path, content)``, such as rows of Spark's ``binaryFile`` source; see RECORD for the columns.

    Headers, lengths and digests are validated; a record that fails has its ``error``. Empty files have no records.
    """
    schema = [
        ("path", pa.string()), ("record", pa.int32()), ("record_id", pa.string()), ("record_type", pa.string()),
        ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("refers_to", pa.string()), ("payload", pa.binary()), ("error", pa.string()),
    ]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(name) for r in rows], kind) for name, kind in schema], [name for name, _ in schema]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            path, content = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            rows, held = [], 0
            for found in records(content or b""):
                rows.append({"path": path} | found)
                held += len(found.get("payload") or b"") + 200
                if held > ARCHIVE_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return files.select("path", "content").mapInArrow(run, RECORD)


PAGE = "urn:x-page:"


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as records: of equal payloads the smallest page_id is the response.

    A null html is the empty payload. Rows that repeat a page_id with the same payload are all responses if that id is
    the smallest. A null page_id comes after all others; if a payload has no other, its rows are all responses. A payload
    that many pages share is not moved: its rows stay in the tasks that read them.
    """
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("key", F.sha1("payload"))
    counted = stored(rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "warc-payloads")
    total = counted.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > total / HOT_SHARE
    # Fewer than HOT_SHARE payloads are hot, so they are broadcast; no other one makes a large group.
    hot = F.broadcast(counted.where(is_hot).select("key", "first"))
    rest = rows.join(hot.select("key"), "key", "left_anti").join(counted.where(~is_hot).select("key", "first"), "key")
    joined = rows.join(hot, "key").unionByName(rest)
    name = F.concat(F.lit(PAGE), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    is_first = F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        name.alias("record_id"),
        "uri",
        "payload",
        F.when(~is_first, F.concat(F.lit(PAGE), F.col("first").cast("string"))).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, error."""
    written = stored(archives(with_revisits(pages), train(pages)), "warc")
    found = read(written)

    def page(name: str):
        return F.when(F.col(name).startswith(PAGE), F.expr(f"try_cast(substring({name}, {len(PAGE) + 1}) AS bigint)"))

    return found.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
        "error",
    )
