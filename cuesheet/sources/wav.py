"""WAV files: bytes of single clips, files written block by block in parts, and blocks read back."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from cuesheet.sources.parts import SCHEMA, write_parts

FRAME_SAMPLES, FRAME_ROWS = 1 << 18, 4_096  # what a frame of blocks may hold
BLOCK_COLUMNS = ["clip_id", "block_no", "start_frame", "total", "l", "r", "rate"]
SMALL = (1 << 32) - 1  # what a size field of the plain format holds


def header(channels: int, rate: int, frames: int, floats: bool, small: int = SMALL) -> bytes:
    """Header of a file with so many frames; files beyond ``small`` bytes get the form with 64-bit sizes."""
    width = 4 if floats else 2
    size = frames * channels * width
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3 if floats else 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    if 36 + size <= small:
        return struct.pack("<4sI4s", b"RIFF", 36 + size, b"WAVE") + form + struct.pack("<4sI", b"data", size)
    sizes = struct.pack("<4sIQQQI", b"ds64", 28, 72 + size, size, frames, 0)
    return struct.pack("<4sI4s", b"RF64", SMALL, b"WAVE") + sizes + form + struct.pack("<4sI", b"data", SMALL)


@dataclass(frozen=True)
class Layout:
    """What a header tells: where the samples begin, and what they are."""

    start: int
    frames: int
    channels: int
    rate: int
    floats: bool


def parse_header(content: bytes) -> Layout:
    """The layout of a WAV file of 16-bit or float samples; other chunks are skipped."""
    kind, _, wave = struct.unpack_from("<4sI4s", content, 0)
    if kind not in (b"RIFF", b"RF64") or wave != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, large = 12, None, None
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        at += 8
        if name == b"ds64":
            large = struct.unpack_from("<Q", content, at + 8)[0]
        elif name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", content, at)
        elif name == b"data":
            if form is None or (form[0], form[5]) not in ((1, 16), (3, 32)):
                raise ValueError("a WAV file of another sample format")
            size = large if size == SMALL and large is not None else size
            return Layout(at, size // form[4], form[1], form[2], form[0] == 3)
        at += size + size % 2
    raise ValueError("a WAV file without samples")


def _payload(samples: np.ndarray, floats: bool) -> bytes:
    if floats:
        return samples.astype("<f4").tobytes()
    return np.rint(np.clip(samples, -1.0, 1.0) * 32767.0).astype("<i2").tobytes()


def wav_bytes(samples: Column, rate: int, floats: bool) -> Column:
    """Bytes of a mono WAV for an array of samples in one row."""

    @F.pandas_udf(BinaryType())
    def encode(clips: pd.Series) -> pd.Series:
        made = []
        for clip in clips:
            data = np.asarray(clip, dtype=np.float32).astype(np.float64)
            made.append(header(1, rate, len(data), floats) + _payload(data, floats))
        return pd.Series(made, index=clips.index)

    return encode(samples)


def output_path(document_path: Column) -> Column:
    """Document path with the extension ``.wav``."""
    return F.concat(F.regexp_replace(document_path, "(?<=[^/])\\.[^./]+$", ""), F.lit(".wav"))


def wav_parts(blocks: DataFrame, rate: int, floats: bool = False, small: int = SMALL) -> DataFrame:
    """The bytes of stereo files, a part for each block: blocks (path, start_frame, total, l, r) of whole clips.

    A projection: every block knows its place in the file, whatever task has it. The first one brings the header.
    """
    width = 2 * (4 if floats else 2)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, start, total, left, right in batch.itertuples(index=False, name=None):
                top = header(2, rate, total, floats, small)
                samples = np.stack([left, right], axis=1).astype(np.float64)
                content = _payload(samples.ravel(), floats)
                size = len(top) + total * width
                rows.append((path, 0, top + content, size) if start == 0 else (path, len(top) + start * width, content, size))
            yield pd.DataFrame(rows, columns=["path", "at", "content", "size"])

    return blocks.select("path", "start_frame", "total", "l", "r").mapInPandas(parts, SCHEMA)


def write_wavs(blocks: DataFrame, folder: str, rate: int, floats: bool = False) -> None:
    """One stereo file per path, written in parts by all tasks that have some: no shuffle, and no limit of 4 GiB.

    Blocks: (path, start_frame, total, l, r), all blocks of each clip. ``folder``: see ``parts.write_parts``.
    """
    write_parts(wav_parts(blocks, rate, floats), folder)


def _file_blocks(batches: Iterator[pd.DataFrame], block_frames: int) -> Iterator[pd.DataFrame]:
    """Blocks of files; many small ones share a frame, which costs more than a block of a few samples."""
    rows, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            layout = parse_header(content)
            kind, width = ("<f4", 4) if layout.floats else ("<i2", 2)
            for number, start in enumerate(range(0, layout.frames, block_frames)):
                frames = min(block_frames, layout.frames - start)
                cells = np.frombuffer(content, kind, frames * layout.channels, layout.start + start * layout.channels * width)
                both = cells.reshape(-1, layout.channels).astype(np.float64) / (1.0 if layout.floats else 32767.0)
                left, right = both[:, 0].astype(np.float32), both[:, min(1, layout.channels - 1)].astype(np.float32)
                rows.append((path, number, start, layout.frames, left, right, layout.rate))
                held += frames
                if held >= FRAME_SAMPLES or len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=BLOCK_COLUMNS)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=BLOCK_COLUMNS)


def read_wavs(spark: SparkSession, pattern: str, block_frames: int) -> DataFrame:
    """Stereo blocks of WAV files: (clip_id, block_no, start_frame, total, l, r, rate); the clip is the path.

    A file is a cell of Spark's ``binaryFile``, so it may have 2 GB; blocks leave it a few at a time. Mono files have equal
    channels, and of more than two channels the first two are read.
    """

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    schema = "clip_id string, block_no bigint, start_frame bigint, total bigint, l array<float>, r array<float>, rate int"
    return files.mapInPandas(lambda batches: _file_blocks(batches, block_frames), schema)
