"""Audio as blocks: (clip_id, block_no, start_frame, total, l array<float>, r array<float>).

The scale path. A clip is cut into blocks of equal length, one row each, and Spark spreads the blocks,
not the clips. A stage that looks beyond its block gets a *halo*: just the frames it needs of the
neighbours, brought by one shuffle on (clip_id, block_no), a key no clip can overload. Inside a row
the samples are numpy arrays.

Recursive stages start inside the halo, far enough away that what is unknown there has decayed below
float32: the filters by ``DECAY`` of their slowest pole, the compressor by its release time. So they fuse
with their neighbours behind one shuffle; ``recursion`` runs them exactly, one at a time, without a halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.operators import frames as FR
from cuesheet.operators.presets import PRESETS, canonical, no_preset, preset_error
from cuesheet.operators.scans import attach, chunk_of

BLOCK_SECONDS = 10
DECAY = 20.0
PAD = 9
SUM_FRAMES = 1 << 22
SCHEMA = "clip_id {id}, block_no bigint, start_frame bigint, total bigint, l array<float>, r array<float>"


def cut_blocks(clips: DataFrame, left: Column, right: Column, block_frames: int) -> DataFrame:
    """Blocks of clips that are one row each."""
    total = F.size(left).cast("bigint")
    starts = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), F.lit(block_frames))
    return clips.where(total > 0).select(
        "clip_id", left.alias("_l"), right.alias("_r"), total.alias("total"), F.explode(starts).alias("start_frame")
    ).select(
        "clip_id",
        chunk_of("start_frame", block_frames).alias("block_no"),
        F.col("start_frame").cast("bigint").alias("start_frame"),
        "total",
        F.slice("_l", (F.col("start_frame") + 1).cast("int"), F.lit(block_frames)).cast("array<float>").alias("l"),
        F.slice("_r", (F.col("start_frame") + 1).cast("int"), F.lit(block_frames)).cast("array<float>").alias("r"),
    )


def block_frames_table(blocks: DataFrame) -> DataFrame:
    """Blocks as stereo frame rows."""
    rows = blocks.select("clip_id", "start_frame", F.posexplode(F.arrays_zip("l", "r")).alias("pos", "s"))
    return rows.select("clip_id", (F.col("start_frame") + F.col("pos")).alias("frame"), "s.l", "s.r")


def with_halo(blocks: DataFrame, before: int, after: int, block_frames: int) -> DataFrame:
    """Replace each block's samples by its own with the frames before and after; ``lead`` counts the former.

    Only the frames asked for travel. A group has one row per neighbouring block in reach.
    """
    back, ahead = math.ceil(before / block_frames), math.ceil(after / block_frames)
    if back == 0 and ahead == 0:
        return blocks.withColumn("lead", F.lit(0)).withColumn("own", F.size("l"))
    step = F.col("_step")
    # A block serves the one `step` further on: it is that many blocks before it.
    size = F.size("l")
    tail = F.least(size, F.greatest(F.lit(0), F.lit(before) - (step - 1) * F.lit(block_frames)))
    head = F.least(size, F.greatest(F.lit(0), F.lit(after) - (-step - 1) * F.lit(block_frames)))
    count = F.when(step > 0, tail).when(step < 0, head).otherwise(size).cast("int")
    first = F.when(step > 0, size - count + 1).otherwise(F.lit(1)).cast("int")
    # Only blocks the clip has are served, however far the halo reaches.
    later = chunk_of(F.col("total") - 1, block_frames) - F.col("block_no")
    steps = F.sequence(-F.least(F.lit(ahead), F.col("block_no")), F.least(F.lit(back), later))
    sent = blocks.select("*", F.explode(steps).alias("_step")).select(
        "clip_id",
        (F.col("block_no") + step).alias("_target"),
        F.struct(
            F.col("block_no").alias("src"),
            F.col("start_frame").alias("start_frame"),
            F.col("total").alias("total"),
            F.slice("l", first, count).alias("l"),
            F.slice("r", first, count).alias("r"),
        ).alias("part"),
    )
    gathered = sent.groupBy("clip_id", F.col("_target").alias("block_no")).agg(
        F.array_sort(F.collect_list("part")).alias("parts")
    )
    own = F.filter("parts", lambda p: p["src"] == F.col("block_no"))
    earlier = F.filter("parts", lambda p: p["src"] < F.col("block_no"))
    return gathered.where(F.size(own) > 0).select(
        "clip_id",
        "block_no",
        F.element_at(own, 1)["start_frame"].alias("start_frame"),
        F.element_at(own, 1)["total"].alias("total"),
        F.flatten(F.transform("parts", lambda p: p["l"])).alias("l"),
        F.flatten(F.transform("parts", lambda p: p["r"])).alias("r"),
        F.aggregate(earlier, F.lit(0), lambda n, p: n + F.size(p["l"])).alias("lead"),
        F.size(F.element_at(own, 1)["l"]).alias("own"),
    )


Kernel = Callable[[np.ndarray, bool, bool], np.ndarray]


@dataclass(frozen=True)
class Local:
    """A stage that needs only nearby frames: ``kernel(samples, at_start, at_end)`` and its reach.

    ``samples`` has shape (rows, channels, frames); the flags tell whether the clip's ends are inside.
    """

    kernel: Kernel
    before: int = 0
    after: int = 0


def fuse(stages: Sequence[Local]) -> Local:
    """Several local stages as one: their reaches add up, so one shuffle serves them all."""

    def kernel(x: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
        for stage in stages:
            x = stage.kernel(x, at_start, at_end).astype(np.float32).astype(np.float64)
        return x

    return Local(kernel, sum(s.before for s in stages), sum(s.after for s in stages))


def run_stage(blocks: DataFrame, stage: Local, block_frames: int) -> DataFrame:
    """Run a local stage on every block with its halo and keep the block's own part.

    Rows of equal length are handled together, so a recursion loops over frames once per batch.
    """
    kernel = stage.kernel
    id_type = blocks.schema["clip_id"].dataType.simpleString()
    plain = ["clip_id", "block_no", "start_frame", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lead, own, start, total = (batch.column(c).to_numpy() for c in ("lead", "own", "start_frame", "total"))
            length = pc.list_value_length(batch.column("l")).to_numpy()
            begin, end = start - lead == 0, start - lead + length == total
            heard = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("l", "r")]
            first = np.cumsum(length, dtype=np.int64) - length
            ends = np.cumsum(own, dtype=np.int64)
            made = [np.empty(int(ends[-1]), np.float32) for _ in heard]
            shapes, member = np.unique(np.stack([length, begin, end], axis=1).astype(np.int64), axis=0, return_inverse=True)
            member = member.reshape(-1)
            for number, (size, at_start, at_end) in enumerate(shapes):
                rows = np.flatnonzero(member == number)
                frames = np.arange(size)
                samples = np.stack([x[first[rows, None] + frames] for x in heard], axis=1).astype(np.float64)
                done = kernel(samples, bool(at_start), bool(at_end)).astype(np.float32)
                kept = frames - lead[rows, None]
                mine = (kept >= 0) & (kept < own[rows, None])
                place = ((ends - own)[rows, None] + kept)[mine]
                for channel, x in enumerate(made):
                    x[place] = done[:, channel][mine]
            cells = pa.array(np.append(0, ends).astype(np.int32))
            sides = [pa.ListArray.from_arrays(cells, pa.array(x)) for x in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *sides], [*plain, "l", "r"])

    haloed = with_halo(blocks, stage.before, stage.after, block_frames)
    return haloed.select(*plain, "l", "r", "lead", "own").mapInArrow(run, SCHEMA.format(id=id_type))


def biquad(kind: str, cutoff_hz: float, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth coefficients (bilinear transform), cutoff clamped inside the band."""
    share = min(max(cutoff_hz / (rate / 2.0), 1e-5), 0.999)
    k = math.tan(math.pi * share / 2.0)
    scale = 1.0 / (1.0 + math.sqrt(2.0) * k + k * k)
    numerator = np.array([k * k, 2 * k * k, k * k]) if kind == "lowpass" else np.array([1.0, -2.0, 1.0])
    denominator = np.array([1.0, 2.0 * (k * k - 1.0) * scale, (1.0 - math.sqrt(2.0) * k + k * k) * scale])
    return numerator * scale, denominator


def filter_halo(kind: str, cutoff_hz: float, rate: int) -> int:
    """Frames until the filter has forgotten its start."""
    radius = max(abs(np.roots(biquad(kind, cutoff_hz, rate)[1])))
    return math.ceil(DECAY / -math.log(min(max(radius, 1e-6), 1 - 1e-9)))


@lru_cache(16)
def _span_matrices(b: tuple, a: tuple, span: int) -> tuple[np.ndarray, ...]:
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    drive = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = [np.eye(2)]
    for _ in range(span):
        powers.append(step @ powers[-1])
    observe = np.array([p[0] for p in powers[:span]])
    impulse = np.concatenate([[b[0]], [(powers[i] @ drive)[0] for i in range(span - 1)]])
    rows, cols = np.indices((span, span))
    inside = np.where(rows >= cols, impulse[np.abs(rows - cols)], 0.0)
    reach = np.array([powers[span - 1 - i] @ drive for i in range(span)])
    return inside, observe, reach, np.array(powers)


def filter_span(
    x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray, span: int = 128
) -> tuple[np.ndarray, np.ndarray]:
    """Filter along the last axis from two state values a row, ``span`` frames at a time; also the state after it.

    Within a span the output is linear in its inputs and the two state values: matrix products.
    """
    n = x.shape[-1]
    inside, observe, reach, powers = _span_matrices(tuple(b), tuple(a), span)
    out = np.empty(x.shape)
    for at in range(0, n, span):
        part = x[..., at : at + span]
        w = part.shape[-1]
        out[..., at : at + w] = part @ inside[:w, :w].T + state @ observe[:w].T
        state = state @ powers[w].T + part @ reach[span - w :]
    return out, state


def steady(first: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which an input that never changes leaves the filter; ``first`` has one frame."""
    level = b.sum() / a.sum()
    return first * np.array([level - b[0], b[2] - a[2] * level])


def _one_pass(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter along the last axis from the steady state of the first sample."""
    return filter_span(x, b, a, steady(x[..., :1], b, a))[0]


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
    """Filter forward and backward; the clip's own ends are extended by odd reflection."""
    n = x.shape[-1]
    if n <= PAD:
        return x
    head = 2 * x[..., :1] - x[..., PAD:0:-1] if at_start else x[..., :0]
    tail = 2 * x[..., -1:] - x[..., -2 : -PAD - 2 : -1] if at_end else x[..., :0]
    longer = np.concatenate([head, x, tail], axis=-1)
    there = _one_pass(longer, b, a)
    back = _one_pass(there[..., ::-1], b, a)[..., ::-1]
    return back[..., head.shape[-1] : head.shape[-1] + n]


def band_filter(kind: str, cutoff_hz: float, rate: int) -> Local:
    """Zero-phase low- or high-pass."""
    b, a = biquad(kind, cutoff_hz, rate)
    halo = filter_halo(kind, cutoff_hz, rate)
    return Local(lambda x, at_start, at_end: zero_phase(x, b, a, at_start, at_end), halo, halo)


TILT_BANDS = (("lowpass", 220.0), ("highpass", 3200.0))


def tilted(x: np.ndarray, lows: np.ndarray, highs: np.ndarray, low_band_db: float, high_band_db: float) -> np.ndarray:
    """The bands, rounded to samples, at their gains, and the rest as it is."""
    lows, highs = lows.astype(np.float32).astype(np.float64), highs.astype(np.float32).astype(np.float64)
    return lows * 10.0 ** (low_band_db / 20.0) + (x - lows - highs) + highs * 10.0 ** (high_band_db / 20.0)


def tilt(low_band_db: float, high_band_db: float, rate: int) -> Local:
    """Gains on what is below 220 Hz and above 3200 Hz; the rest stays."""
    low, high = (biquad(*band, rate) for band in TILT_BANDS)

    def kernel(x: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
        bands = [zero_phase(x, *band, at_start, at_end) for band in (low, high)]
        return tilted(x, *bands, low_band_db, high_band_db)

    halo = max(filter_halo(*band, rate) for band in TILT_BANDS)
    return Local(kernel, halo, halo)


def follow(peaks: np.ndarray, start: np.ndarray, attack: float, release: float) -> tuple[np.ndarray, np.ndarray]:
    """Levels over ``peaks`` (rows, frames) from the ``start`` of each row, and how much the last level moves with it.

    The frames are cut into as many spans as a span has frames, and all spans take a frame at once, from levels that
    are guesses but for the first span's. A level's map is piecewise linear, and each span gives its slope here, so
    guesses are mended along the slopes until they stand still; the spans that are right grow by one a time at least.
    """
    rows, n = peaks.shape
    span = max(1, math.isqrt(n))
    count = n // span
    levels = np.empty((rows, n))

    def walk(parts: np.ndarray, level: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope = np.ones_like(level)
        for i, peak in enumerate(parts):
            keep = np.where(peak > level, attack, release)
            level = keep * level + (1.0 - keep) * peak
            slope *= keep
            out[i] = level
        return level, slope

    parts = np.ascontiguousarray(peaks[:, : count * span].reshape(rows, count, span).transpose(2, 0, 1))
    out = np.empty_like(parts)
    guess = np.tile(np.asarray(start, np.float64).reshape(rows, 1), (1, count))
    for _ in range(count):
        level, slope = walk(parts, guess, out)
        better = guess.copy()
        for k in range(1, count):
            better[:, k] = level[:, k - 1] + slope[:, k - 1] * (better[:, k - 1] - guess[:, k - 1])
        better = np.maximum(better, 0.0)
        done = np.abs(better - guess).max(initial=0.0) <= 1e-15 * max(1.0, np.abs(guess).max(initial=0.0))
        guess = better
        if done:
            break
    levels[:, : count * span] = out.transpose(1, 2, 0).reshape(rows, -1)
    last, slopes = (level[:, -1], slope.prod(axis=1)) if count else (np.asarray(start, np.float64), np.ones(rows))
    rest = np.empty((n - count * span, rows))
    _, more = walk(peaks[:, count * span :].T, last, rest)
    levels[:, count * span :] = rest.T
    return levels, slopes * more


def follower_rates(attack_ms: float, release_ms: float, rate: int) -> tuple[float, float]:
    """What a frame keeps of the level when it rises and when it falls."""
    return tuple(math.exp(-1.0 / max(rate * ms / 1000.0, 1.0)) for ms in (attack_ms, release_ms))


def gain_curve(threshold_db: float, ratio: float, makeup_db: float) -> Callable[[np.ndarray], np.ndarray]:
    if ratio <= 0:
        raise ValueError("ratio must be positive")

    def gain(levels: np.ndarray) -> np.ndarray:
        loud = 20.0 * np.log10(np.maximum(levels, 1e-6))
        change = np.where(loud > threshold_db, (threshold_db - loud) * (1.0 - 1.0 / ratio), 0.0)
        return 10.0 ** ((change + makeup_db) / 20.0)

    return gain


def compressor(
    threshold_db: float, ratio: float, attack_ms: float, release_ms: float, makeup_db: float, rate: int
) -> Local:
    """Level follower over the louder channel, then a gain curve. The follower looks back only."""
    attack, release = follower_rates(attack_ms, release_ms, rate)
    gain = gain_curve(threshold_db, ratio, makeup_db)

    def kernel(x: np.ndarray, _: bool, __: bool) -> np.ndarray:
        levels, _ = follow(np.abs(x).max(axis=1), np.zeros(len(x)), attack, release)
        return x * gain(levels)[:, None, :]

    return Local(kernel, math.ceil(DECAY * max(rate * attack_ms / 1000.0, rate * release_ms / 1000.0, 1.0)))


def echoes(taps: Sequence[tuple[int, float, float]], dry: float) -> Local:
    """Dry signal plus delayed copies of the mono mean."""

    def kernel(x: np.ndarray, _: bool, __: bool) -> np.ndarray:
        out = x * dry
        mono = x.mean(axis=1)
        n = x.shape[-1]
        for delay, left, right in taps:
            if delay < n:
                out[:, 0, delay:] += mono[:, : n - delay] * left
                out[:, 1, delay:] += mono[:, : n - delay] * right
        return out

    return Local(kernel, max((t[0] for t in taps), default=0))


def mid_side(mid_gain: float, side_gain: float) -> Local:
    def kernel(x: np.ndarray, _: bool, __: bool) -> np.ndarray:
        mid = 0.5 * (x[:, 0] + x[:, 1]) * mid_gain
        side = 0.5 * (x[:, 0] - x[:, 1]) * side_gain
        return np.stack([mid + side, mid - side], axis=1)

    return Local(kernel)


def mid_side_stage(blocks: DataFrame, mid_gain: float, side_gain: float) -> DataFrame:
    """A projection: both channels are in the row."""
    both = F.arrays_zip("l", "r")
    mid = lambda s: F.lit(0.5) * (s["l"].cast("double") + s["r"]) * F.lit(mid_gain)
    side = lambda s: F.lit(0.5) * (s["l"].cast("double") - s["r"]) * F.lit(side_gain)
    return blocks.withColumns(
        {
            "l": F.transform(both, lambda s: (mid(s) + side(s)).cast("float")),
            "r": F.transform(both, lambda s: (mid(s) - side(s)).cast("float")),
        }
    )


def _noise_like(name: str, channel: int, seed: int) -> Column:
    return F.transform(name, lambda _, i: FR.white_noise(F.col("start_frame") + i, channel, seed))


def noise_stage(blocks: DataFrame, relative_db: float, seed: int = FR.NOISE_SEED) -> DataFrame:
    """Noise bed at a level relative to the clip. Levels are summed per block first, then per clip."""
    noisy = blocks
    for number, name in enumerate(("l", "r")):
        noisy = noisy.withColumn(f"n{name}", _noise_like(name, number, seed))
    power = lambda name: F.aggregate(name, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    sums = noisy.select(
        "clip_id", "total", (power("l") + power("r")).alias("s"), (power("nl") + power("nr")).alias("n")
    )
    levels = sums.groupBy("clip_id").agg(
        F.sqrt(F.sum("s") / (F.max("total") * 2)).alias("signal"), F.sqrt(F.sum("n") / (F.max("total") * 2)).alias("noise")
    )
    factor = F.greatest(F.col("signal") * F.lit(10.0 ** (relative_db / 20.0)), F.lit(1e-4)) / F.greatest(
        F.col("noise"), F.lit(1e-6)
    )
    joined = attach(noisy, levels.select("clip_id", factor.alias("k")), ["clip_id"], chunk_of("block_no", 64))
    mixed = lambda a, b: F.transform(
        F.arrays_zip(a, b), lambda s: (s[a].cast("double") + s[b] * F.col("k")).cast("float")
    )
    return joined.select("clip_id", "block_no", "start_frame", "total", mixed("l", "nl").alias("l"), mixed("r", "nr").alias("r"))


def hop_energies(blocks: DataFrame, hop: int) -> DataFrame:
    """Energy of every hop of every clip: (clip_id, hop, s, n).

    Each block sums up its own parts of hops in its row, so what is shuffled is a number for each hop, and a hop that
    lies across blocks is added up from its parts.
    """
    start, size = F.col("start_frame"), F.size("l")
    first, last = chunk_of("start_frame", hop), chunk_of(start + size - 1, hop)

    def part(number: Column) -> Column:
        low = F.greatest(number * hop, start) - start
        high = F.least((number + 1) * hop, start + size) - start
        square = lambda acc, x: acc + x.cast("double") * x.cast("double")
        energy = lambda name: F.aggregate(F.slice(name, (low + 1).cast("int"), (high - low).cast("int")), F.lit(0.0), square)
        return F.struct(number.alias("hop"), (energy("l") + energy("r")).alias("s"), (high - low).alias("n"))

    parts = blocks.where(size > 0).select("clip_id", F.explode(F.transform(F.sequence(first, last), part)).alias("p"))
    return parts.groupBy("clip_id", F.col("p.hop").alias("hop")).agg(F.sum("p.s").alias("s"), F.sum("p.n").alias("n"))


def loudness_stage(blocks: DataFrame, rate: int, target: float = -24.0) -> DataFrame:
    """Master step: one linear gain per clip from its gated loudness, measured on hops."""
    hop = FR.hop_frames(rate)
    gains = FR.gain_of_hops(hop_energies(blocks, hop), hop, target).select("clip_id", "gain")
    joined = attach(blocks, gains, ["clip_id"], chunk_of("block_no", 64))
    louder = lambda name: F.transform(name, lambda v: (v * F.col("gain")).cast("float"))
    return joined.select("clip_id", "block_no", "start_frame", "total", louder("l").alias("l"), louder("r").alias("r"))


def local_stage(stage: str, params: dict, rate: int) -> Local | None:
    """The local form of a preset's stage; null for the stages that need a level of the whole clip."""
    if stage in ("highpass", "lowpass"):
        return band_filter(stage, params["cutoff_hz"], rate)
    if stage == "tilt":
        return tilt(**params, rate=rate)
    if stage == "compressor":
        return compressor(**params, rate=rate)
    if stage == "mid_side":
        return mid_side(**params)
    if stage == "reflections":
        return echoes(FR.reflection_taps(rate, params["taps"]), params["dry_mix"])
    if stage == "repeats":
        rest = {name: value for name, value in params.items() if name != "dry_mix"}
        return echoes(FR.repeat_taps(rate, **rest), params["dry_mix"])
    return None


def apply_preset(blocks: DataFrame, preset: str, rate: int, block_frames: int) -> DataFrame:
    """All stages of a preset in order. Gaps and margins are not here, so they stay as they are.

    Neighbouring local stages run fused, behind one shuffle.
    """
    pending: list[Local] = []
    for stage, params in PRESETS[preset]:
        local = local_stage(stage, params, rate)
        if local is not None:
            pending.append(local)
            continue
        if pending:
            blocks = run_stage(blocks, fuse(pending), block_frames)
            pending = []
        blocks = noise_stage(blocks, **params) if stage == "noise" else loudness_stage(blocks, rate)
    return run_stage(blocks, fuse(pending), block_frames) if pending else blocks


def apply_custom(
    blocks: DataFrame, factory: Callable[[], Kernel], before: int, after: int, block_frames: int
) -> DataFrame:
    """A user's own stage. The factory runs once per task, and the kernel must keep no state."""
    made: list[Kernel] = []

    def kernel(x: np.ndarray, at_start: bool, at_end: bool) -> np.ndarray:
        if not made:
            made.append(factory())
        return made[0](x, at_start, at_end)

    return run_stage(blocks, Local(kernel, before, after), block_frames)


def apply_stateful(blocks: DataFrame, factory: Callable[[], Callable[[np.ndarray, object], tuple[np.ndarray, object]]]) -> DataFrame:
    """A user's own stage that remembers what it heard: ``(x, state) -> (y, state)`` with ``x`` (channels, frames) of a block.

    The factory runs once per task. Blocks pass in order, with state None at the start of every clip, so the result is
    that of the whole clip. As nothing is known of the state, a clip is one task's walk, a batch of blocks at a time;
    a stage whose steps can be composed is spread further by ``recursion.scan``. ``block_no`` must be unique in a clip.
    """
    plain = ["clip_id", "block_no", "start_frame", "total", "l", "r"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stage, clip, state = factory(), None, None
        for batch in batches:
            left, right = [], []
            for own, l, r in zip(batch["clip_id"], batch["l"], batch["r"]):
                if own != clip:
                    clip, state = own, None
                made, state = stage(np.stack([l, r]).astype(np.float64), state)
                left.append(made[0].astype(np.float32))
                right.append(made[1].astype(np.float32))
            yield batch.assign(l=left, r=right)

    ordered = blocks.select(*plain).repartition("clip_id").sortWithinPartitions("clip_id", "block_no")
    return ordered.mapInPandas(walk, ordered.schema)


def preset_problems(blocks: DataFrame, column: str = "preset") -> DataFrame:
    """Clips that ``by_preset`` leaves out, with the reason: (clip_id, message)."""
    filtered = [name for name, stages in PRESETS.items() if any(s in ("highpass", "lowpass", "tilt") for s, _ in stages)]
    name = F.col(column)
    short = canonical(name).isin(*filtered) & (F.col("total") <= PAD)
    message = F.coalesce(
        F.when(~no_preset(name), preset_error(name)),
        F.when(short, F.concat(F.lit(f"A clip of up to {PAD} frames cannot be filtered by preset '"), canonical(name), F.lit("'"))),
    )
    return blocks.select("clip_id", message.alias("message")).where("message is not null").distinct()


def by_preset(
    blocks: DataFrame, rate: int, block_frames: int, column: str = "preset", used: Sequence[str] = tuple(PRESETS)
) -> DataFrame:
    """Blocks that name their clip's preset, in any spelling the catalog knows: one plan per preset.

    ``used`` says which presets occur, if that is known: the others need no plan.

    Clips without a preset, by null or by its name for none, pass. ``preset_problems`` lists what is left out: names
    that are no preset, and clips too short for their preset's filters.
    """
    plain = ["clip_id", "block_no", "start_frame", "total", "l", "r"]
    named = blocks.withColumn("_preset", F.when(~no_preset(F.col(column)), canonical(F.col(column))))
    done = named.where("_preset is null").select(*plain)
    for name in used:
        stages = PRESETS[name]
        mine = named.where(F.col("_preset") == name)
        if any(s in ("highpass", "lowpass", "tilt") for s, _ in stages):
            mine = mine.where(F.col("total") > PAD)
        done = done.unionByName(apply_preset(mine.select(*plain), name, rate, block_frames))
    return done


def resample_blocks(blocks: DataFrame, input_rate: int, output_rate: int, block_frames: int) -> DataFrame:
    """Rational resample of blocks: each yields the output frames whose centre lies in it. ``r`` may be null (mono)."""
    if input_rate == output_rate:
        return blocks
    up, down = FR.resample_ratio(input_rate, output_rate)
    half = 10 * max(up, down)
    taps = FR.resample_taps(up, down)
    reach = math.ceil(half / up) + 1
    id_type = blocks.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                begin, end = row.start_frame, row.start_frame + row.own
                first, last = -(-begin * up // down), -(-end * up // down)
                m = np.arange(first, last)
                k = np.arange(row.start_frame - row.lead, row.start_frame - row.lead + len(row.l))
                # Per output frame the inputs in reach of its taps, as positions in this row.
                near = (m * down - half + up - 1) // up
                place = near[:, None] + np.arange(2 * half // up + 1)[None, :]
                tap = m[:, None] * down - place * up + half
                at = place - k[0] if len(k) else place
                valid = (tap >= 0) & (tap <= 2 * half) & (at >= 0) & (at < len(k))
                weight = np.where(valid, taps[np.clip(tap, 0, 2 * half)], 0.0)
                at = np.clip(at, 0, max(len(k) - 1, 0))
                made = [
                    None if x is None else (np.asarray(x, dtype=np.float64)[at] * weight).sum(axis=1).astype(np.float32)
                    for x in (row.l, row.r)
                ]
                rows.append((row.clip_id, row.block_no, first, -(-row.total * up // down), *made))
            yield pd.DataFrame(rows, columns=["clip_id", "block_no", "start_frame", "total", "l", "r"])

    haloed = with_halo(blocks, reach, reach, block_frames)
    return haloed.select("clip_id", "block_no", "start_frame", "total", "l", "r", "lead", "own").mapInPandas(
        run, SCHEMA.format(id=id_type)
    )


def convert_blocks(blocks: DataFrame, input_rate: int, output_rate: int, mono: bool, block_frames: int) -> DataFrame:
    """Channels and rate in one go: the mean of both channels is a projection, the resampling one shuffle of halos.

    Mono blocks have their samples in ``l``, and a null ``r``.
    """
    if mono:
        mean = lambda s: ((s["l"].cast("double") + s["r"].cast("double")) / 2).cast("float")
        blocks = blocks.withColumns(
            {"l": F.transform(F.arrays_zip("l", "r"), mean), "r": F.lit(None).cast("array<float>")}
        )
    return resample_blocks(blocks, input_rate, output_rate, block_frames)


def asr_blocks(blocks: DataFrame, rate: int, block_frames: int) -> DataFrame:
    """What a recogniser is given: (clip_id, block_no, start_frame, total, samples), mono at its rate."""
    mono = convert_blocks(blocks, rate, FR.ASR_RATE, True, block_frames)
    return mono.select("clip_id", "block_no", "start_frame", "total", F.col("l").alias("samples"))


def fill_silence(
    mixed: DataFrame,
    lengths: DataFrame,
    keys: list[str],
    block_frames: int,
    channels: Sequence[str] = ("samples",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """All blocks of every timeline of ``lengths`` (keys, frames), those in which nothing sounds as zeros.

    Without them a writer behind the mix would move what follows a pause. Equal keys spread by block. ``keep`` names
    columns of ``lengths`` that stay.
    """
    count = F.ceil(F.col("frames") / block_frames).cast("bigint")
    every = lengths.where("frames > 0").select(
        *keys, *keep, F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("block_no")
    )
    silent = F.array_repeat(F.lit(0.0), block_frames)
    joined = every.join(mixed, [*keys, "block_no"], "left")
    return joined.withColumns({name: F.coalesce(name, silent) for name in channels})


def mix_blocks(
    placed: DataFrame, keys: list[str], block_frames: int, salts: int = 16, channels: Sequence[str] = ("samples",)
) -> DataFrame:
    """Mix placed pieces into timeline blocks: (keys, block_no, an array<double> for each channel).

    Input: keys, ``start_frame``, and the channels' arrays, equally long in a row. Pieces are cut at block edges and summed in three
    rounds: within each task's batches, per salted block, and per block, so that a moment at which a
    third of all pieces sound does not meet in one task. Until the last round a sum has just the frames from its first piece's
    beginning to its last one's end.
    """
    size = F.size(channels[0])
    last = F.floor((F.col("start_frame") + size - 1) / block_frames)
    first = F.floor(F.col("start_frame") / block_frames)
    cut = placed.where(size > 0).select(
        *keys, "start_frame", *channels, F.explode(F.sequence(first, last)).alias("block_no")
    )
    edge = F.col("block_no") * block_frames
    begin = F.greatest(F.col("start_frame"), edge)
    end = F.least(F.col("start_frame") + size, edge + block_frames)
    cell = lambda name: F.slice(name, (begin - F.col("start_frame") + 1).cast("int"), (end - begin).cast("int"))
    pieces = cut.select(
        *keys,
        "block_no",
        # By task: what a task says of a block goes to one place, however often it has to say it.
        (F.spark_partition_id() % salts).alias("salt"),
        (begin - edge).cast("int").alias("at"),
        *[cell(name).cast("array<double>").alias(name) for name in channels],
    )
    names = [*keys, "block_no", "salt"]

    def rounds(by: list[str], held_back: bool, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Sums of each batch; of rows that arrive sorted the last block is held back for the next batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                if held is not None:
                    batch = pa.concat_batches([held, batch])
                    held = None
                for made in _block_sums(batch, by, channels, block_frames, whole):
                    if held is not None:
                        yield held
                    held = made
                if held is not None and held_back:
                    ready, held = held.slice(0, held.num_rows - 1), held.slice(held.num_rows - 1)
                    if ready.num_rows:
                        yield ready
                elif held is not None:
                    yield held
                    held = None
            if held is not None:
                yield held

        return run

    def summed(rows: DataFrame, by: list[str], whole: bool) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(rounds(by, True, whole), pieces.schema)

    combined = pieces.mapInArrow(rounds(names, False, False), pieces.schema)
    return summed(summed(combined, names, False), names[:-1], True).select(*keys, "block_no", *channels)


def _block_sums(
    batch: pa.RecordBatch, by: Sequence[str], channels: Sequence[str], block_frames: int, whole: bool
) -> Iterator[pa.RecordBatch]:
    """A batch's pieces, summed for each block, in the order in which blocks first come.

    Samples stay flat arrays, without an object for each piece, and at most ``SUM_FRAMES`` of sums, or one block, are made at once.
    """
    if not batch.num_rows:
        return
    code = np.zeros(batch.num_rows, np.int64)
    for name in by:
        values = batch.column(name).dictionary_encode(null_encoding="encode")
        code = code * (len(values.dictionary) + 1) + values.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1].astype(np.int64)
    first = np.unique(code, return_index=True)[1]
    turn = np.empty(len(first), np.int64)
    turn[np.argsort(first)] = np.arange(len(first))
    code = turn[code]
    if (np.diff(code) < 0).any():
        order = np.argsort(code, kind="stable")
        batch, code = batch.take(pa.array(order)), code[order]
    at = batch.column("at").to_numpy().astype(np.int64)
    ends = at + pc.list_value_length(batch.column(channels[0])).to_numpy()
    opens = np.flatnonzero(np.diff(code, prepend=-1))
    low, high = np.minimum.reduceat(at, opens), np.maximum.reduceat(ends, opens)
    if whole:
        low, high = np.zeros_like(low), np.full_like(high, block_frames)
    places = np.concatenate([[0], np.cumsum(high - low)])
    closes = np.append(opens[1:], batch.num_rows)
    done = 0
    while done < len(opens):
        upto = max(done + 1, int(np.searchsorted(places, places[done] + SUM_FRAMES, side="right")) - 1)
        rows = slice(opens[done], closes[upto - 1])
        part = batch.slice(rows.start, rows.stop - rows.start)
        sizes, group = (ends - at)[rows], code[rows]
        begin = places[group] - places[done] + at[rows] - low[group]
        frame = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        total = places[upto] - places[done]
        cells = pa.array((places[done : upto + 1] - places[done]).astype(np.int32))
        heads = batch.take(pa.array(opens[done:upto]))
        columns = []
        for name in batch.schema.names:
            if name in channels:
                samples = part.column(name).flatten().to_numpy(zero_copy_only=False)
                sums = pa.array(np.bincount(frame, samples, total))
                columns.append(pa.ListArray.from_arrays(cells, sums).cast(batch.schema.field(name).type))
            elif name == "at":
                columns.append(pa.array(low[done:upto].astype(np.int32)))
            else:
                columns.append(heads.column(name))
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        done = upto
