"""Filters and level followers over blocks, equal to a run over the whole clip, without a halo.

A recursive stage knows its past by a small *state*. What a block does to that state is a *step*, and steps compose:

* A second-order filter moves two numbers by an affine map. The way back over a block starts from what the way there
  left of it, and that is affine in the state too, so one reading of a block gives its steps for both ways.
* A level follower moves its level by a continuous, monotone, piecewise linear map, which is convex if it rises faster
  than it falls and concave otherwise, so a few points hold it with an error that is known.

Blocks are read for their steps, ``scan`` turns the steps into the state before every block, and blocks are read once
more, each with its own state. Steps and states are some hundred bytes a block; ``scan`` composes them in groups of
bounded size, level by level, so no clip is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cuesheet.operators import blocks as B
from cuesheet.operators.scans import chunk_of
from cuesheet.session import stored

GROUP = 1024
EXACT = 1e-12
CELLS = 1 << 19
CHANNELS = 2

Steps = Callable[[list[np.ndarray]], np.ndarray]
Move = Callable[[np.ndarray, np.ndarray], np.ndarray]


def scan(steps: DataFrame, most: int, compose: Steps, move: Move, initial: np.ndarray, group: int = GROUP) -> DataFrame:
    """(clip_id, no, state): the state before each of ``steps(clip_id, no, step array<double>)``, in the order of ``no``.

    ``no`` is less than ``most``. Up: groups of steps become one step of the next level, until a clip has one group.
    Down: a group's state before it, moved on by its steps.
    """
    id_type = steps.schema["clip_id"].dataType.simpleString()
    levels = [steps.select("clip_id", "no", "step", chunk_of("no", group).alias("_group"))]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            done = []
            for clip, part, step in zip(batch["clip_id"], batch["_group"], batch["step"]):
                if held and key != (clip, part):
                    done.append((*key, compose(held)))
                    held = []
                key = (clip, part)
                held.append(step)
            yield pd.DataFrame(done, columns=["clip_id", "no", "step"])
        if held:
            yield pd.DataFrame([(*key, compose(held))], columns=["clip_id", "no", "step"])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            found = []
            for clip, part, step, before in zip(batch["clip_id"], batch["_group"], batch["step"], batch["before"]):
                if key != (clip, part):
                    key, state = (clip, part), np.asarray(before, np.float64)
                found.append(state)
                state = move(step, state)
            yield batch[["clip_id", "no"]].assign(state=found)

    def sorted_groups(rows: DataFrame) -> DataFrame:
        return rows.repartition("clip_id", "_group").sortWithinPartitions("clip_id", "_group", "no")

    size = most
    while size > group:
        made = sorted_groups(levels[-1]).mapInPandas(fold, f"clip_id {id_type}, no bigint, step array<double>")
        levels.append(stored(made.withColumn("_group", chunk_of("no", group)), "recursion-steps"))
        size = -(-size // group)
    first = F.array(*[F.lit(float(v)) for v in initial])
    states = None
    for level in reversed(levels):
        if states is None:
            rows = level.withColumn("before", first)
        else:
            rows = level.join(states.select("clip_id", F.col("no").alias("_group"), F.col("state").alias("before")), ["clip_id", "_group"])
        states = sorted_groups(rows).mapInPandas(spread, f"clip_id {id_type}, no bigint, state array<double>")
    return states


def alike(lengths: Sequence[int]) -> Iterator[list[int]]:
    """Rows of equal length, to be handled as one array of at most ``CELLS`` frames, or of one row."""
    found: dict[int, list[int]] = {}
    for place, n in enumerate(lengths):
        found.setdefault(n, []).append(place)
    for n, places in found.items():
        many = max(1, CELLS // max(1, n))
        for at in range(0, len(places), many):
            yield places[at : at + many]


def samples(batch: pd.DataFrame, places: Sequence[int]) -> np.ndarray:
    """(rows, channels, frames) of blocks of equal length."""
    return np.stack([np.stack([batch["l"].iat[i], batch["r"].iat[i]]) for i in places]).astype(np.float64)


# Filters: a step is, for every filter and channel, a 2 x 2 matrix and what is added; a state two numbers each.


def compose_affine(steps: list[np.ndarray]) -> np.ndarray:
    parts = np.stack(steps).reshape(len(steps), -1, 6)
    matrix, added = parts[0, :, :4].reshape(-1, 2, 2), parts[0, :, 4:]
    for part in parts[1:]:
        own = part[:, :4].reshape(-1, 2, 2)
        added = np.einsum("kij,kj->ki", own, added) + part[:, 4:]
        matrix = own @ matrix
    return np.concatenate([matrix.reshape(-1, 4), added], axis=1).ravel()


def move_affine(step: np.ndarray, state: np.ndarray) -> np.ndarray:
    part = np.asarray(step).reshape(-1, 6)
    return (np.einsum("kij,kj->ki", part[:, :4].reshape(-1, 2, 2), state.reshape(-1, 2)) + part[:, 4:]).ravel()


def _constant(states: np.ndarray) -> np.ndarray:
    """The step that forgets what was before."""
    states = states.reshape(-1, 2)
    return np.concatenate([np.zeros((len(states), 4)), states], axis=1).ravel()


@lru_cache(8)
def _moves(kind: str, cutoff_hz: float, rate: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n frames make of a state on the way there, and of it on the way back, without input."""
    b, a = B.biquad(kind, cutoff_hz, rate)
    y, there = B.filter_span(np.zeros((2, n)), b, a, np.eye(2))
    _, back = B.filter_span(y[:, ::-1], b, a, np.zeros((2, 2)))
    return there.T, back.T


def filtered(
    blocks: DataFrame,
    filters: Sequence[tuple[str, float]],
    rate: int,
    block_frames: int,
    combine: Callable[[np.ndarray, list[np.ndarray]], np.ndarray] = lambda x, found: found[0],
    group: int = GROUP,
) -> DataFrame:
    """Zero-phase filters (kind, cutoff) over whole clips; ``combine(samples, outputs of the filters)`` makes the result.

    The clip's ends are extended by odd reflection. Clips of up to ``blocks.PAD`` frames have no such extension: they
    are left out, and ``blocks.preset_problems`` names them. The blocks are read twice and should be stored.
    """
    pad = B.PAD
    made = tuple(B.biquad(kind, cutoff, rate) for kind, cutoff in filters)
    id_type = blocks.schema["clip_id"].dataType.simpleString()
    blocks = blocks.where(F.col("total") > pad)
    last = chunk_of(F.col("total") - 1, block_frames)
    ends_of = ["head_l", "head_r", "tail_l", "tail_r"]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            there, back = [None] * len(batch), [None] * len(batch)
            for places in alike(batch["l"].map(len)):
                x = samples(batch, places)
                zero = np.zeros((len(places), CHANNELS, 2))
                steps, backs = [], []
                for k, (b, a) in enumerate(made):
                    y, end = B.filter_span(x, b, a, zero)
                    _, turned = B.filter_span(y[..., ::-1], b, a, zero)
                    for moved, added, into in zip(_moves(*filters[k], rate, x.shape[-1]), (end, turned), (steps, backs)):
                        into.append(np.concatenate([np.broadcast_to(moved.ravel(), (*zero.shape[:2], 4)), added], axis=2))
                for cells, into in ((steps, there), (backs, back)):
                    for place, cell in zip(places, np.stack(cells, axis=1).reshape(len(places), -1)):
                        into[place] = cell
            yield batch[["clip_id", "block_no", "total", *ends_of]].assign(there=there, back=back)

    # A block also hands on what it holds of the clip's first and last ten frames.
    start, size = F.col("start_frame"), F.size("l")
    head = F.greatest(F.lit(0), F.least(size, F.lit(pad + 1) - start)).cast("int")
    skip = F.least(size, F.greatest(F.lit(0), F.col("total") - (pad + 1) - start)).cast("int")
    cells = [F.slice(name, F.lit(1), head).alias(f"head_{name}") for name in ("l", "r")]
    cells += [F.slice(name, skip + 1, size - skip).alias(f"tail_{name}") for name in ("l", "r")]
    schema = ", ".join(f"{name} array<float>" for name in ends_of)
    found = stored(
        blocks.select("clip_id", "block_no", "total", "l", "r", *cells).mapInPandas(
            summarise, f"clip_id {id_type}, block_no bigint, total bigint, {schema}, there array<double>, back array<double>"
        ),
        "recursion-blocks",
    )
    most = found.agg(F.max(last)).first()[0]
    if most is None:
        return blocks.select("clip_id", "block_no", "start_frame", "total", "l", "r")

    pieces = found.where(F.size("head_l") + F.size("tail_l") > 0).select("clip_id", "total", F.struct("block_no", *ends_of).alias("p"))
    joined = pieces.groupBy("clip_id").agg(F.max("total").alias("total"), F.array_sort(F.collect_list("p")).alias("p"))
    ends = joined.select("clip_id", "total", *[F.flatten(F.col(f"p.{name}")).alias(name) for name in ends_of])

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state at the first frame: over the reflected head, from its steady state."""
        for batch in batches:
            steps = []
            for left, right in zip(batch["head_l"], batch["head_r"]):
                x = np.stack([left, right]).astype(np.float64)
                lead = 2 * x[:, :1] - x[:, :0:-1]
                steps.append(_constant(np.stack([B.filter_span(lead, b, a, B.steady(lead[:, :1], b, a))[1] for b, a in made])))
            yield pd.DataFrame({"clip_id": batch["clip_id"], "no": np.zeros(len(batch), np.int64), "step": steps})

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state at the last frame on the way back: over the reflected tail, there and back."""
        for batch in batches:
            steps = []
            for left, right, state in zip(batch["tail_l"], batch["tail_r"], batch["state"]):
                x = np.stack([left, right]).astype(np.float64)
                tail = 2 * x[:, -1:] - x[:, -2::-1]
                found = []
                for (b, a), before in zip(made, np.asarray(state).reshape(len(made), CHANNELS, 2)):
                    y = B.filter_span(tail, b, a, before)[0][:, ::-1]
                    found.append(B.filter_span(y, b, a, B.steady(y[:, :1], b, a))[1])
                steps.append(_constant(np.stack(found)))
            yield pd.DataFrame({"clip_id": batch["clip_id"], "no": np.zeros(len(batch), np.int64), "step": steps})

    def back_steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = []
            for there, back, state in zip(batch["there"], batch["back"], batch["state"]):
                own = np.array(there).reshape(-1, 6)
                own[:, 4:] = move_affine(back, np.asarray(state)).reshape(-1, 2)
                steps.append(own.ravel())
            yield pd.DataFrame({"clip_id": batch["clip_id"], "no": batch["no"], "step": steps})

    schema = f"clip_id {id_type}, no bigint, step array<double>"
    width = len(made) * CHANNELS
    same = np.tile([1.0, 0.0, 0.0, 1.0, 0.0, 0.0], width)
    blank, total = np.zeros(2 * width), most + 3
    close = ends.select("clip_id", (last + 2).alias("no"), F.array(*[F.lit(float(v)) for v in same]).alias("step"))
    forward = ends.select("clip_id", "head_l", "head_r").mapInPandas(starts, schema)
    forward = forward.unionByName(found.select("clip_id", (F.col("block_no") + 1).alias("no"), F.col("there").alias("step")))
    there = stored(scan(forward.unionByName(close), total, compose_affine, move_affine, blank, group), "recursion-states")
    before = there.select("clip_id", (F.col("no") - 1).alias("block_no"), "state")
    # The way back counts from the clip's end: its reflected tail is 0, the last block 1.
    reverse = (last - F.col("block_no") + 1).alias("no")
    tails = ends.withColumn("no", last + 2).join(there, ["clip_id", "no"]).select("clip_id", "tail_l", "tail_r", "state")
    middle = found.join(before, ["clip_id", "block_no"]).select("clip_id", reverse, "there", "back", "state")
    backward = tails.mapInPandas(turns, schema).unionByName(middle.mapInPandas(back_steps, schema))
    back = scan(backward, total, compose_affine, move_affine, blank, group).withColumnRenamed("state", "turned")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [None] * len(batch), [None] * len(batch)
            for places in alike(batch["l"].map(len)):
                x, done = samples(batch, places), []
                begin, end = (
                    np.stack([batch[name].iat[i] for i in places]).reshape(len(places), len(made), CHANNELS, 2)
                    for name in ("state", "turned")
                )
                for k, (b, a) in enumerate(made):
                    y = B.filter_span(x, b, a, begin[:, k])[0]
                    done.append(B.filter_span(y[..., ::-1], b, a, end[:, k])[0][..., ::-1])
                for place, out in zip(places, combine(x, done).astype(np.float32)):
                    left[place], right[place] = out
            yield batch[["clip_id", "block_no", "start_frame", "total"]].assign(l=left, r=right)

    states = found.select("clip_id", "block_no", reverse).join(back, ["clip_id", "no"]).join(before, ["clip_id", "block_no"])
    rows = blocks.join(states.select("clip_id", "block_no", "state", "turned"), ["clip_id", "block_no"])
    rows = rows.select("clip_id", "block_no", "start_frame", "total", "l", "r", "state", "turned")
    return rows.mapInPandas(run, B.SCHEMA.format(id=id_type))


def band_filter(blocks: DataFrame, kind: str, cutoff_hz: float, rate: int, block_frames: int, group: int = GROUP) -> DataFrame:
    """Zero-phase low- or high-pass over whole clips; see ``filtered``."""
    return filtered(blocks, [(kind, cutoff_hz)], rate, block_frames, group=group)


def tilt(blocks: DataFrame, low_band_db: float, high_band_db: float, rate: int, block_frames: int, group: int = GROUP) -> DataFrame:
    """Gains on what is below and above the bands of ``blocks.tilt``, over whole clips; see ``filtered``."""
    mix = lambda x, found: B.tilted(x, *found, low_band_db, high_band_db)
    return filtered(blocks, B.TILT_BANDS, rate, block_frames, mix, group)


# Followers: a step is the points of a map, first the levels before, then those after; a state is one level.


def level_maps(peaks: np.ndarray, top: float, attack: float, release: float) -> list[np.ndarray]:
    """What each of ``peaks`` (blocks, frames) makes of any level from 0 to ``top``, to at most EXACT of ``top``.

    A map is convex or concave: between two points it lies between the chord and the tangents, so it needs no more
    points where these are close, and else one where the tangents meet.
    """

    def at(row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [B.follow(peaks[row[p]], x[p], attack, release) for p in alike([peaks.shape[1]] * len(x))]
        return np.concatenate([f[0][:, -1] for f in found]), np.concatenate([f[1] for f in found])

    row, x = np.repeat(np.arange(len(peaks)), 2), np.tile([0.0, top], len(peaks))
    y, slope = at(row, x)
    while True:
        run, rise, bend = np.diff(x), np.diff(y), slope[:-1] - slope[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            meet = x[:-1] + (rise - slope[1:] * run) / bend
            gap = np.abs((rise / run - slope[:-1]) * (meet - x[:-1]))
        same = (row[:-1] == row[1:]) & (bend != 0) & (meet > x[:-1]) & (meet < x[1:])
        new = same & (gap > EXACT * top)
        if not new.any():
            cuts = np.flatnonzero(np.diff(row)) + 1
            return [np.concatenate(pair) for pair in zip(np.split(x, cuts), np.split(y, cuts))]
        more = at(row[:-1][new], meet[new])
        row, x = np.concatenate([row, row[:-1][new]]), np.concatenate([x, meet[new]])
        order = np.lexsort([x, row])
        row, x = row[order], x[order]
        y, slope = np.concatenate([y, more[0]])[order], np.concatenate([slope, more[1]])[order]


def compose_levels(steps: list[np.ndarray]) -> np.ndarray:
    """Points of the maps one after another; where all levels have come together, two points are enough."""
    x, y = np.split(np.asarray(steps[0]), 2)
    for step in steps[1:]:
        own_x, own_y = np.split(np.asarray(step), 2)
        inside = own_x[(own_x > y[0]) & (own_x < y[-1])]
        more = np.unique(np.concatenate([x, np.interp(inside, y, x)]))
        x, y = more, np.interp(np.interp(more, x, y), own_x, own_y)
        if y[-1] - y[0] <= EXACT * x[-1]:
            x, y = x[[0, -1]], y[[0, -1]]
    return np.concatenate([x, y])


def move_level(step: np.ndarray, state: np.ndarray) -> np.ndarray:
    return np.interp(state, *np.split(np.asarray(step), 2))


def compressor(
    blocks: DataFrame,
    threshold_db: float,
    ratio: float,
    attack_ms: float,
    release_ms: float,
    makeup_db: float,
    rate: int,
    group: int = GROUP,
) -> DataFrame:
    """``blocks.compressor`` over whole clips. The blocks are read three times and should be stored.

    The first reading finds the loudest sample of all, which bounds every level.
    """
    attack, release = B.follower_rates(attack_ms, release_ms, rate)
    gain = B.gain_curve(threshold_db, ratio, makeup_db)
    id_type = blocks.schema["clip_id"].dataType.simpleString()
    loudest = lambda name: F.coalesce(F.array_max(F.transform(name, F.abs)), F.lit(0.0).cast("float"))
    top, most = blocks.agg(F.max(F.greatest(loudest("l"), loudest("r"))), F.max("block_no")).first()
    if most is None:
        return blocks.select("clip_id", "block_no", "start_frame", "total", "l", "r")
    top = max(float(top), 1e-6)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = [None] * len(batch)
            for places in alike(batch["l"].map(len)):
                peaks = np.abs(samples(batch, places)).max(axis=1)
                for place, step in zip(places, level_maps(peaks, top, attack, release)):
                    steps[place] = step
            yield batch[["clip_id", "no"]].assign(step=steps)

    named = blocks.select("clip_id", F.col("block_no").alias("no"), "l", "r")
    steps = stored(named.mapInPandas(summarise, f"clip_id {id_type}, no bigint, step array<double>"), "recursion-levels")
    states = scan(steps, most + 1, compose_levels, move_level, np.zeros(1), group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            left, right = [None] * len(batch), [None] * len(batch)
            for places in alike(batch["l"].map(len)):
                x = samples(batch, places)
                start = np.array([batch["state"].iat[i][0] for i in places])
                levels, _ = B.follow(np.abs(x).max(axis=1), start, attack, release)
                for place, out in zip(places, (x * gain(levels)[:, None, :]).astype(np.float32)):
                    left[place], right[place] = out
            yield batch[["clip_id", "block_no", "start_frame", "total"]].assign(l=left, r=right)

    rows = blocks.join(states.withColumnRenamed("no", "block_no"), ["clip_id", "block_no"])
    rows = rows.select("clip_id", "block_no", "start_frame", "total", "l", "r", "state")
    return rows.mapInPandas(run, B.SCHEMA.format(id=id_type))
