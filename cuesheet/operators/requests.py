"""Render requests: keys, caches, batches and routing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuesheet.operators import alignment as A
from cuesheet.operators.scans import attach, chunk_of, global_position, salt
from cuesheet.session import stored

BATCH_SIZE = 10
LANES = 4
GRID = 65_536
VERSION = 1
# What JSON writes with a backslash and one character; the backslash comes first.
SHORT_ESCAPES = {"\\": "\\", '"': '"', "\b": "b", "\t": "t", "\n": "n", "\f": "f", "\r": "r"}


def digest(rows: DataFrame, keys: Sequence[str], *content: Column, name: str = "digest") -> DataFrame:
    """Order-aware digest of a group's rows whose state has a fixed size.

    Every row must carry its position in ``content``. Its sha-256 is cut into numbers that are added
    up, so the digest combines on the map side and no group is ever gathered in one place.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in content])
    hashed = rows.select(*keys, F.sha2(text, 256).alias("_h"))
    lanes = [
        F.conv(F.substring("_h", 1 + 15 * lane, 15), 16, 10).cast("decimal(20,0)").alias(f"_l{lane}")
        for lane in range(LANES)
    ]
    sums = hashed.select(*keys, *lanes).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"_l{lane}").alias(f"_l{lane}") for lane in range(LANES)]
    )
    joined = F.concat_ws(
        ":", F.col("n_rows").cast("string"), *[F.col(f"_l{lane}").cast("string") for lane in range(LANES)]
    )
    return sums.select(*keys, "n_rows", F.sha2(joined, 256).alias(name))


def audio_digests(blocks: DataFrame, grid: int = GRID) -> DataFrame:
    """Digest of each clip's samples, whatever blocks it comes in: (clip_id, frames, channels, audio).

    Blocks are cut at a fixed grid of frames, a cell's samples are hashed as float32 in the order of frames, and the
    cells' hashes are added up by ``digest``. A task holds a cell, so a clip may have any length. ``r`` is null for mono.
    Clips without frames have no blocks and are left out. Not a number and both zeros count by their bits.
    """
    begin, end = F.col("start_frame"), F.col("start_frame") + F.size("l")
    cut = blocks.where(F.size("l") > 0).withColumn(
        "_cell", F.explode(F.sequence(chunk_of(begin, grid), chunk_of(end - 1, grid)))
    )
    low, high = F.greatest(begin, F.col("_cell") * grid), F.least(end, (F.col("_cell") + 1) * grid)
    part = lambda name: F.slice(name, (low - begin + 1).cast("int"), (high - low).cast("int")).alias(name)
    cells = cut.select("clip_id", "_cell", "total", low.alias("_low"), part("l"), part("r")).groupBy("clip_id", "_cell").agg(
        F.max("total").cast("bigint").alias("frames"), F.array_sort(F.collect_list(F.struct("_low", "l", "r"))).alias("_parts")
    )
    whole = cells.select(
        "clip_id", "_cell", "frames",
        F.flatten(F.transform("_parts", lambda p: p["l"])).alias("l"), F.flatten(F.transform("_parts", lambda p: p["r"])).alias("r"),
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shas, channels = [], []
            for l, r in zip(batch["l"], batch["r"]):
                both = [l] if r is None else [l, r]
                channels.append(len(both))
                shas.append(hashlib.sha256(np.stack(both, axis=1).astype("<f4").tobytes()).hexdigest())
            yield batch[["clip_id", "_cell", "frames"]].assign(channels=channels, _sha=shas)

    id_type = blocks.schema["clip_id"].dataType.simpleString()
    rows = whole.mapInPandas(hashed, f"clip_id {id_type}, _cell bigint, frames bigint, channels int, _sha string")
    keys = ["clip_id", "frames", "channels"]
    return digest(rows, keys, F.col("_cell"), F.col("_sha"), name="audio").select(*keys, "audio")


def alignment_keys(contents: DataFrame, audio: DataFrame, rate: int, version: int = VERSION) -> DataFrame:
    """Key of what an alignment depends on: (clip_id, key).

    ``contents``: clip_id and the ``digest`` of the script's contents. ``audio``: from ``audio_digests``. The key changes with any
    content, sample, frame count, channel count, rate and format version.
    """
    parts = [F.col(c).cast("string") for c in ("digest", "audio", "frames", "channels")]
    key = F.sha2(F.concat_ws(":", *parts, F.lit(str(rate)), F.lit(str(version))), 256)
    return contents.select("clip_id", "digest").join(audio, "clip_id").select("clip_id", key.alias("key"))


def _json_string(text: Column) -> Column:
    """A JSON string with all but printable ASCII escaped, lower-case; null stays ``null``."""
    short = text
    for char, letter in SHORT_ESCAPES.items():
        short = F.replace(short, F.lit(char), F.lit("\\" + letter))
    units = lambda piece: F.regexp_replace(F.lower(F.hex(F.encode(piece, "UTF-16BE"))), "(.{4})", r"\\u$1")
    pieces = lambda some: F.transform(
        F.regexp_extract_all(some, F.lit("[ -~]+|[^ -~]+"), F.lit(0)), lambda p: F.when(p.rlike("^[ -~]"), p).otherwise(units(p))
    )
    whole = A.let(lambda some: F.when(some.rlike("[^ -~]"), F.array_join(pieces(some), "")).otherwise(some), some=short)
    return F.coalesce(F.concat(F.lit('"'), whole, F.lit('"')), F.lit("null"))


def canonical_key(script: Column, voices: Column) -> Column:
    """Render key of a request held in one row, equal to keys already on disk as file names.

    Those hash sorted, ASCII-escaped JSON.
    """
    samples = F.array_join(F.transform(voices, _json_string), ", ")
    return F.sha2(F.concat(F.lit('{"normalized_script": '), _json_string(script), F.lit(', "voice_samples": ['), samples, F.lit("]}")), 256)


def split_by_cache(requests: DataFrame, cache: DataFrame, mode: str, key: str = "key") -> DataFrame:
    """State of each request: ``hit``, ``skip`` (cache-only mode) or ``compute``.

    Equal requests share a key, and copies may be a third of all, so the join is salted.
    """
    if mode not in ("cache", "live"):
        raise ValueError("mode must be 'cache' or 'live'")
    missing = "skip" if mode == "cache" else "compute"
    joined = attach(requests, cache.withColumn("_hit", F.lit(True)), [key], salt(*requests.columns), "left")
    return joined.withColumn("state", F.when(F.col("_hit"), "hit").otherwise(F.lit(missing))).drop("_hit")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests the cache lacks."""
    known = cache.select(key, F.lit(True).alias("_hit"))
    joined = attach(requests, known, [key], salt(*requests.columns), "left")
    return joined.where("_hit is null").select(*requests.columns)


def apply_positions(contents: DataFrame, cache: DataFrame, key: str = "key", idx: str = "idx") -> DataFrame:
    """Put cached start positions onto contents by position; unequal lengths are an error.

    ``cache``: key and ``start_positions`` array. Contents carry ``script`` columns of their own beside
    the key where several scripts share it; the join on (key, idx) is salted by them.
    """
    positions = cache.select(key, F.posexplode("start_positions").alias(idx, "start_pos")).withColumn(
        idx, F.col(idx).cast("bigint")
    )
    counts = contents.groupBy(key).agg(F.max(idx).alias("_last"))
    lengths = cache.select(key, F.size("start_positions").cast("bigint").alias("n_positions"))
    # Equal scripts share a key, so the number of contents is told by the last position.
    sound = counts.join(lengths, key).where("_last + 1 = n_positions").select(key)
    return attach(contents, positions.join(sound, key, "left_semi"), [key, idx], salt(*contents.columns))


def position_errors(contents: DataFrame, cache: DataFrame, key: str = "key", idx: str = "idx") -> DataFrame:
    """Keys whose cached positions do not fit their contents."""
    counts = contents.groupBy(key).agg((F.max(idx) + 1).alias("n_contents"))
    lengths = cache.select(key, F.size("start_positions").cast("bigint").alias("n_positions"))
    return (
        counts.join(lengths, key)
        .where("n_contents <> n_positions")
        .withColumn("message", F.lit("Cached forced-alignment metadata length does not match contents"))
    )


def zip_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Results matched to requests by (batch_no, pos); whatever lacks a partner is marked."""
    left = requests.withColumn("_request", F.lit(True))
    right = results.withColumn("_result", F.lit(True))
    joined = left.join(right, ["batch_no", "pos"], "full_outer")
    status = (
        F.when(F.col("_result").isNull(), "missing result")
        .when(F.col("_request").isNull(), "result without request")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_request", "_result")


def batches(requests: DataFrame, major: str, minor: Sequence[str], size: int = BATCH_SIZE) -> DataFrame:
    """Batch number and place in the batch, in registration order over all requests."""
    numbered = global_position(requests, major, minor, "position")
    return numbered.select(
        *requests.columns,
        F.floor(F.col("position") / size).cast("bigint").alias("batch_no"),
        (F.col("position") % size).alias("pos"),
    )


def ranked_batches(requests: DataFrame, order: Sequence[str], size: int = BATCH_SIZE) -> DataFrame:
    """``batches`` in the order of any columns."""
    return batches(requests, order[0], order[1:], size)


def first_batch(requests: DataFrame, major: str, minor: Sequence[str], size: int = BATCH_SIZE) -> DataFrame:
    """The next batch to hand out: the first requests in registration order.

    A top-k plan (each task keeps ``size`` rows), not a sort of everything.
    """
    return requests.orderBy(major, *minor).limit(size)


def route(requests: DataFrame, backend: str) -> DataFrame:
    return requests.where(F.col("tts") == backend)


def replay_frames(frames: Column, native_rate: Column, output_rate: Column) -> Column:
    """Frames after a rational resample: ceil(frames * up / down)."""
    a, b = output_rate.cast("bigint"), native_rate.cast("bigint")
    return F.floor((frames.cast("bigint") * a + b - 1) / b).cast("bigint")


def run_renderer(
    requests: DataFrame, renderer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Seam for a speech or alignment model: an iterator function over batches of requests.

    Whatever the function loads before its loop is loaded once per Python worker. Requests are spread
    by batch, so that one batch stays together and no task gets all of them. Batch numbers of a stream count from 0 in
    each micro-batch; its ``epoch`` keeps them apart.
    """
    by = [c for c in ("epoch", "batch_no") if c in requests.columns]
    order = [*by, "pos", *[c for c in ("block_no",) if c in requests.columns]]
    return requests.repartition(*by).sortWithinPartitions(*order).mapInPandas(renderer, schema)


