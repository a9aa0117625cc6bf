"""Audio as frame rows: (clip_id, frame, ch, value) or, in stereo, (clip_id, frame, l, r).

Every operator is a projection or an aggregate keyed by clip *and* frame, so a clip of any length
spreads over all tasks. Delays and resampling are sums of shifted, weighted copies: an explode over a
fixed list of taps and a grouped sum that combines on the map side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.functions.timing import db_gain
from cuesheet.operators.scans import attach, chunk_of

NOISE_SEED = 7
ASR_RATE = 16_000  # of the audio that a recogniser is given
FRAME_CHUNK = 65_536


def stereo_frames(clips: DataFrame, left: Column, right: Column) -> DataFrame:
    """Stereo frame rows of clips held as arrays, one per channel."""
    return clips.select("clip_id", F.posexplode(F.arrays_zip(left.alias("l"), right.alias("r"))).alias("frame", "s")).select(
        "clip_id", F.col("frame").cast("bigint").alias("frame"), F.col("s.l").alias("l"), F.col("s.r").alias("r")
    )


def convert_channels(frames: DataFrame, inputs: int, outputs: int) -> DataFrame:
    """Same count: unchanged; otherwise the mean of all channels, repeated."""
    if outputs < 1:
        raise ValueError("output_channels must be at least 1")
    if inputs == outputs:
        return frames
    mono = frames if inputs == 1 else frames.groupBy("clip_id", "frame").agg(F.avg("value").cast("float").alias("value"))
    return mono.select(
        "clip_id", "frame", F.explode(F.sequence(F.lit(0), F.lit(outputs - 1))).alias("ch"), "value"
    )


def mid_side(stereo: DataFrame, mid_gain: float, side_gain: float) -> DataFrame:
    mid = F.lit(0.5) * (F.col("l").cast("double") + F.col("r").cast("double")) * F.lit(mid_gain)
    side = F.lit(0.5) * (F.col("l").cast("double") - F.col("r").cast("double")) * F.lit(side_gain)
    return stereo.select("clip_id", "frame", (mid + side).cast("float").alias("l"), (mid - side).cast("float").alias("r"))


def gain(stereo: DataFrame, decibels: float) -> DataFrame:
    factor = db_gain(decibels)
    return stereo.select(
        "clip_id", "frame", (F.col("l") * factor).cast("float").alias("l"), (F.col("r") * factor).cast("float").alias("r")
    )


def half_even(value: float) -> int:
    return int(np.rint(value))


def reflection_taps(rate: int, taps: Sequence[tuple[float, float, float]]) -> list[tuple[int, float, float]]:
    """(frames, left gain, right gain) of delays in milliseconds; a delay is at least one frame."""
    return [(max(1, half_even(rate * ms / 1000.0)), left, right) for ms, left, right in taps]


def repeat_taps(
    rate: int, delay_ms: float, stereo_offset_ms: float, feedback: float, repeats: int, wet_gain: float
) -> list[tuple[int, float, float]]:
    """Echo taps: the n-th comes n delays later and fainter; the right ear hears its own, softer."""
    found = []
    for n in range(1, int(repeats) + 1):
        level = wet_gain * feedback ** (n - 1)
        found.append((max(1, half_even(rate * delay_ms * n / 1000.0)), level, 0.0))
        found.append((max(1, half_even(rate * (delay_ms + stereo_offset_ms) * n / 1000.0)), 0.0, level * 0.92))
    return found


def add_taps(stereo: DataFrame, lengths: DataFrame, taps: Sequence[tuple[int, float, float]], dry: float) -> DataFrame:
    """Dry signal plus delayed copies of its mono mean; what falls past the clip's end is dropped.

    ``lengths``: (clip_id, frames).
    """
    l, r = F.col("l").cast("double"), F.col("r").cast("double")
    mono = (l + r) / 2
    copies = F.array(
        F.struct(F.lit(0).alias("d"), (l * dry).alias("l"), (r * dry).alias("r")),
        *[F.struct(F.lit(d).alias("d"), (mono * gl).alias("l"), (mono * gr).alias("r")) for d, gl, gr in taps],
    )
    shifted = stereo.select("clip_id", "frame", F.explode(copies).alias("c")).select(
        "clip_id", (F.col("frame") + F.col("c.d")).alias("frame"), "c.l", "c.r"
    )
    summed = shifted.groupBy("clip_id", "frame").agg(
        F.sum("l").cast("float").alias("l"), F.sum("r").cast("float").alias("r")
    )
    return attach(summed, lengths, ["clip_id"], chunk_of("frame", FRAME_CHUNK)).where("frame < frames").drop("frames")


def clip_lengths(stereo: DataFrame) -> DataFrame:
    return stereo.groupBy("clip_id").agg((F.max("frame") + 1).alias("frames"))


def rms(stereo: DataFrame) -> DataFrame:
    """Root mean square over both channels of each clip."""
    square = F.pow(F.col("l").cast("double"), 2) + F.pow(F.col("r").cast("double"), 2)
    return stereo.groupBy("clip_id").agg(F.sqrt(F.sum(square) / (F.count(F.lit(1)) * 2)).alias("rms"))


def difference_rms(left: DataFrame, right: DataFrame) -> DataFrame:
    """RMS of the difference of two versions of the same clips."""
    other = right.select("clip_id", "frame", F.col("l").alias("l2"), F.col("r").alias("r2"))
    joined = left.join(other, ["clip_id", "frame"])
    delta = lambda a, b: F.pow(F.col(a).cast("double") - F.col(b).cast("double"), 2)
    return joined.groupBy("clip_id").agg(
        F.sqrt(F.sum(delta("l", "l2") + delta("r", "r2")) / (F.count(F.lit(1)) * 2)).alias("rms")
    )


def white_noise(frame: Column, channel: int, seed: int = NOISE_SEED) -> Column:
    """Standard normal noise that depends on seed, frame and channel only (Box-Muller on mixed numbers).

    Mixing is multiplication modulo a prime below 2^31, so that any SQL engine gives the same noise.
    """
    prime = F.lit((1 << 31) - 1).cast("bigint")

    def unit(salt: int) -> Column:
        start = (frame.cast("bigint") * 1_000_003 + channel * 7_919 + seed * 104_729 + salt * 15_485_863) % prime
        once = (start * 48_271) % prime
        return ((((once * once + start) % prime) * 69_621) % prime + 0.5) / prime

    return F.sqrt(F.lit(-2.0) * F.log(unit(0))) * F.cos(F.lit(2.0 * math.pi) * unit(1))


def add_noise(stereo: DataFrame, relative_db: float, seed: int = NOISE_SEED) -> DataFrame:
    """Noise bed at a level relative to each clip's own."""
    noisy = stereo.select(
        "*", white_noise(F.col("frame"), 0, seed).alias("nl"), white_noise(F.col("frame"), 1, seed).alias("nr")
    )
    power = lambda a, b: F.sqrt(
        F.sum(F.pow(F.col(a).cast("double"), 2) + F.pow(F.col(b).cast("double"), 2)) / (F.count(F.lit(1)) * 2)
    )
    levels = noisy.groupBy("clip_id").agg(power("l", "r").alias("signal"), power("nl", "nr").alias("noise"))
    factor = F.greatest(F.col("signal") * db_gain(relative_db), F.lit(1e-4)) / F.greatest(F.col("noise"), F.lit(1e-6))
    factors = levels.select("clip_id", factor.alias("k"))
    return attach(noisy, factors, ["clip_id"], chunk_of("frame", FRAME_CHUNK)).select(
        "clip_id",
        "frame",
        (F.col("l") + F.col("nl") * F.col("k")).cast("float").alias("l"),
        (F.col("r") + F.col("nr") * F.col("k")).cast("float").alias("r"),
    )


def loudness_gain(stereo: DataFrame, rate: int, target: float = -24.0) -> DataFrame:
    """One gain per clip that brings its gated loudness to a target.

    Mean square over 400 ms windows every 100 ms; windows below -70 dB, then those more than 10 dB
    below the mean of the rest, do not count. A linear two-pass step, not a dynamic one.
    """
    hop = hop_frames(rate)
    square = F.pow(F.col("l").cast("double"), 2) + F.pow(F.col("r").cast("double"), 2)
    hops = stereo.groupBy("clip_id", chunk_of("frame", hop).alias("hop")).agg(
        F.sum(square).alias("s"), F.count(F.lit(1)).alias("n")
    )
    return gain_of_hops(hops, hop, target)


def hop_frames(rate: int) -> int:
    """Frames of 100 ms, the step of the loudness windows."""
    return max(1, rate // 10)


def gain_of_hops(hops: DataFrame, hop: int, target: float) -> DataFrame:
    """``loudness_gain`` from the energy of every hop: (clip_id, hop, s: sum of squares, n: frames)."""
    # Window w covers hops w .. w+3; a clip shorter than a window has one, starting at 0.
    windows = (
        hops.select("clip_id", "s", "n", F.explode(F.sequence(F.greatest(F.col("hop") - 3, F.lit(0)), F.col("hop"))).alias("w"))
        .groupBy("clip_id", "w")
        .agg((F.sum("s") / F.sum("n")).alias("ms"), F.sum("n").alias("n"))
        .where((F.col("n") >= 4 * hop) | (F.col("w") == 0))
    )
    level = F.lit(10.0) * F.log10(F.greatest("ms", F.lit(1e-12)))
    loud = windows.where(level > -70.0)
    gates = loud.groupBy("clip_id").agg(F.avg("ms").alias("mean"))
    kept = attach(loud, gates, ["clip_id"], chunk_of("w", FRAME_CHUNK)).where(F.col("ms") > F.col("mean") / 10)
    final = kept.groupBy("clip_id").agg((F.lit(10.0) * F.log10(F.avg("ms"))).alias("loudness"))
    clips = windows.select("clip_id").distinct().join(final, "clip_id", "left")
    return clips.select(
        "clip_id", "loudness", F.coalesce(F.pow(F.lit(10.0), (F.lit(target) - F.col("loudness")) / 20), F.lit(1.0)).alias("gain")
    )


def apply_gain(stereo: DataFrame, gains: DataFrame) -> DataFrame:
    joined = attach(stereo, gains.select("clip_id", "gain"), ["clip_id"], chunk_of("frame", FRAME_CHUNK))
    return joined.select(
        "clip_id", "frame", (F.col("l") * F.col("gain")).cast("float").alias("l"), (F.col("r") * F.col("gain")).cast("float").alias("r")
    )


def resample_ratio(input_rate: int, output_rate: int) -> tuple[int, int]:
    common = math.gcd(input_rate, output_rate)
    return output_rate // common, input_rate // common


def resample_taps(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed sinc low-pass (beta 5) of 20 * max(up, down) + 1 taps, scaled by ``up``."""
    widest = max(up, down)
    half = 10 * widest
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / widest) * np.kaiser(2 * half + 1, 5.0)
    return taps / taps.sum() * up


def resample(frames: DataFrame, lengths: DataFrame, input_rate: int, output_rate: int) -> DataFrame:
    """Rational resample of (clip_id, frame, ch, value): weighted copies summed per output frame.

    ``lengths``: (clip_id, frames), the input length.
    """
    if input_rate == output_rate:
        return frames
    up, down = resample_ratio(input_rate, output_rate)
    half = 10 * max(up, down)
    taps = F.array(*[F.lit(float(t)) for t in resample_taps(up, down)])
    center = F.col("frame") * up
    first = F.greatest(F.ceil((center - half) / F.lit(down)), F.lit(0)).cast("bigint")
    last = F.floor((center + half) / F.lit(down)).cast("bigint")
    spread = frames.select(
        "clip_id", "ch", "frame", F.col("value").cast("double").alias("v"), F.explode(F.sequence(first, last)).alias("m")
    )
    weight = F.get(taps, (F.col("m") * down - F.col("frame") * up + half).cast("int"))
    summed = spread.groupBy("clip_id", "ch", F.col("m").alias("frame")).agg(
        F.sum(F.col("v") * weight).cast("float").alias("value")
    )
    ends = lengths.select("clip_id", F.ceil(F.col("frames") * up / F.lit(down)).cast("bigint").alias("_end"))
    return attach(summed, ends, ["clip_id"], chunk_of("frame", FRAME_CHUNK)).where("frame < _end").drop("_end")


def convert_format(
    frames: DataFrame, lengths: DataFrame, inputs: int, input_rate: int, outputs: int, output_rate: int
) -> DataFrame:
    """Resample, then convert channels."""
    return convert_channels(resample(frames, lengths, input_rate, output_rate), inputs, outputs)


def asr_view(frames: DataFrame, lengths: DataFrame, inputs: int, rate: int, asr_rate: int = ASR_RATE) -> DataFrame:
    """Mono view at the recogniser's rate."""
    return resample(convert_channels(frames, inputs, 1).withColumn("ch", F.lit(0)), lengths, rate, asr_rate)
