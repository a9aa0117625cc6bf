"""Placing clips on timelines, composing, trimming and slicing.

Children of a container are ordered by an integer ``idx`` that is unique inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.functions.timing import overrides, to_frames, to_seconds, truncated_frame
from cuesheet.operators.scans import CHUNK_ROWS, Running, attach, chunk_of, running
from cuesheet.session import cut_lineage, stored

FRAME_BLOCK = 65_536
CHECKPOINT_LEVELS = 3


def place(
    children: DataFrame,
    keys: Sequence[str],
    rate: int,
    idx: str = "idx",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Start and end frame of every child, one after the other.

    Input: keys, idx, ``frames``, ``pre_gap``, ``post_gap``, ``length`` (seconds, length nullable).
    """
    pre, post = to_frames(F.col("pre_gap"), rate), to_frames(F.col("post_gap"), rate)
    occupied = F.coalesce(to_frames(F.col("length"), rate), pre + F.col("frames") + post)
    sized = children.withColumn("occupied", occupied)
    cursors = running(
        sized, keys, [idx], [Running("cursor", "sum", F.col("occupied"))], chunk_of(idx, chunk_rows)
    )
    start = F.col("cursor") + pre
    return cursors.withColumn("start_frame", start).withColumn(
        "end_frame", F.col("start_frame") + F.col("frames")
    )


def summarise(placed: DataFrame, keys: Sequence[str], rate: int, idx: str = "idx") -> DataFrame:
    """Span, outer gaps and margins of each container. Both ends of the span include frame 0."""
    has_margins = {"pre_margin", "post_margin"} <= set(placed.columns)
    margins = (
        [
            F.min_by("pre_margin", idx).alias("pre_margin"),
            F.max_by("post_margin", idx).alias("post_margin"),
        ]
        if has_margins
        else []
    )
    spans = placed.groupBy(*keys).agg(
        F.least(F.lit(0), F.min("start_frame")).cast("bigint").alias("min_start"),
        F.greatest(F.lit(0), F.max("end_frame")).cast("bigint").alias("max_end"),
        F.sum("occupied").alias("cursor_end"),
        F.count(F.lit(1)).alias("n_children"),
        *margins,
    )
    return (
        spans.withColumn("frames", F.greatest(F.lit(0), F.col("max_end") - F.col("min_start")).cast("bigint"))
        .withColumn("pre_gap", to_seconds(F.col("min_start"), rate))
        .withColumn("post_gap", to_seconds(F.col("cursor_end") - F.col("max_end"), rate))
    )


def trim_to_boundary(summaries: DataFrame, rate: int) -> DataFrame:
    """Frames kept of each production: audio before its start or past its end is cut, gaps become silence."""
    pre, post = to_frames(F.col("pre_gap"), rate), to_frames(F.col("post_gap"), rate)
    return (
        summaries.withColumn("trim_start", F.greatest(F.lit(0), -pre).cast("bigint"))
        .withColumn(
            "trim_end",
            F.greatest(F.col("trim_start"), F.col("frames") - F.greatest(F.lit(0), -post)).cast("bigint"),
        )
        .withColumn("lead_frames", F.greatest(F.lit(0), pre).cast("bigint"))
        .withColumn("tail_frames", F.greatest(F.lit(0), post).cast("bigint"))
        .withColumn(
            "final_frames",
            F.greatest(F.lit(0), F.least(F.col("trim_end"), F.col("frames")) - F.least(F.col("trim_start"), F.col("frames")))
            + F.col("lead_frames")
            + F.col("tail_frames"),
        )
    )


def trim_frames(frames: DataFrame, trimmed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Move the mixed frames of each production to its trimmed buffer; leading silence is implied."""
    bounds = trimmed.select(*keys, "trim_start", "trim_end", "lead_frames")
    return (
        attach(frames, bounds, keys, chunk_of("frame", FRAME_BLOCK))
        .where((F.col("frame") >= F.col("trim_start")) & (F.col("frame") < F.col("trim_end")))
        .withColumn("frame", F.col("frame") - F.col("trim_start") + F.col("lead_frames"))
        .drop("trim_start", "trim_end", "lead_frames")
    )


def compose_tree(nodes: DataFrame, rate: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Compose nested containers bottom-up, then give every node its absolute start.

    Input: ``production``, ``node_id``, ``parent_id``, ``depth`` (root 0), ``idx``, ``is_container``,
    ``frames`` (leaves), ``pre_gap``, ``post_gap``, ``length``. Returns (placements, summaries); the
    root's own summary is the one with depth 0. The loop runs over depth, never over rows.
    """
    keys = ["production", "parent_id"]
    placed_levels: dict[int, DataFrame] = {}
    summary_levels: dict[int, DataFrame] = {}
    below: DataFrame | None = None
    for depth in range(max_depth, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is not None:
            level = _with_results(level, below)
        # Each level is read several times below; a stored table keeps the plans from nesting.
        placed = stored(place(level, keys, rate), "placed")
        placed_levels[depth] = placed
        below = summarise(placed, keys, rate).withColumnRenamed("parent_id", "node_id").withColumn(
            "depth", F.lit(depth - 1)
        )
        summary_levels[depth - 1] = below
    absolute: DataFrame | None = None
    placements: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        parents = summary_levels[depth - 1].select(
            "production", F.col("node_id").alias("parent_id"), F.col("min_start").alias("_min")
        )
        if absolute is None:
            parents = parents.withColumn("_base", F.lit(0).cast("bigint"))
        else:
            bases = absolute.where("is_container").select(
                "production", F.col("node_id").alias("parent_id"), F.col("abs_start").alias("_base")
            )
            parents = parents.join(bases, keys)
        joined = attach(placed_levels[depth], parents, keys, chunk_of("idx"))
        absolute = joined.withColumn("abs_start", F.col("_base") + F.col("start_frame") - F.col("_min")).drop(
            "_base", "_min"
        )
        if depth % CHECKPOINT_LEVELS == 0 and depth < max_depth:
            absolute = cut_lineage(absolute)
        placements.append(absolute)
    union = placements[0]
    for level in placements[1:]:
        union = union.unionByName(level)
    summaries = summary_levels[0]
    for depth in range(1, max_depth):
        summaries = summaries.unionByName(summary_levels[depth])
    return union, summaries.unionByName(_without_children(nodes, summaries), allowMissingColumns=True)


def _without_children(nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Empty results of containers, and of productions, in which there is nothing to place."""
    containers = nodes.where((F.col("depth") == 0) | F.col("is_container")).select("production", "node_id", "depth")
    empty = containers.join(summaries.select("production", "node_id"), ["production", "node_id"], "left_anti")
    none = F.lit(0).cast("bigint")
    return empty.select(
        "production", "node_id", "depth",
        *[none.alias(name) for name in ("min_start", "max_end", "cursor_end", "n_children", "frames")],
        F.lit(0.0).alias("pre_gap"), F.lit(0.0).alias("post_gap"),
    )


def _with_results(level: DataFrame, results: DataFrame) -> DataFrame:
    """Containers take frames and, unless they state their own, gaps from their composed children."""
    composed = results.select(
        "production",
        "node_id",
        F.col("frames").alias("_frames"),
        F.col("pre_gap").alias("_pre"),
        F.col("post_gap").alias("_post"),
    )
    joined = level.join(composed, ["production", "node_id"], "left")
    return (
        joined.withColumn("frames", F.when(F.col("is_container"), F.coalesce("_frames", F.lit(0))).otherwise(F.col("frames")))
        .withColumn("pre_gap", overrides(F.col("pre_gap"), F.col("_pre")))
        .withColumn("post_gap", overrides(F.col("post_gap"), F.col("_post")))
        .drop("_frames", "_pre", "_post")
    )


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = nodes.select("production", F.col("parent_id").alias("node_id")).where("node_id is not null")
    return nodes.join(parents.distinct(), ["production", "node_id"], "left_anti")


def mix(placed: DataFrame, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """Sum overlapping clips frame by frame. Silent gaps have no rows.

    ``samples`` is an array of mono samples per clip or block; the sum is combined on the map side.
    """
    exploded = placed.select(
        *keys, "start_frame", F.posexplode(samples).alias("pos", "value")
    )
    return exploded.groupBy(*keys, (F.col("start_frame") + F.col("pos")).alias("frame")).agg(
        F.sum(F.col("value").cast("double")).alias("value")
    )


def with_silence(mixed: DataFrame, lengths: DataFrame, keys: Sequence[str], length: str = "frames") -> DataFrame:
    """Every frame of each container, zero where nothing sounds.

    The frame grid is made in blocks, so that no single row has to hold a whole timeline.
    """
    blocks = lengths.where(F.col(length) > 0).select(
        *keys,
        length,
        F.explode(F.sequence(F.lit(0), F.floor((F.col(length) - 1) / FRAME_BLOCK))).alias("_block"),
    )
    first = F.col("_block") * FRAME_BLOCK
    last = F.least(first + FRAME_BLOCK, F.col(length)) - 1
    grid = blocks.select(*keys, F.explode(F.sequence(first, last)).alias("frame"))
    return grid.join(mixed, [*keys, "frame"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def slice_bounds(start: Column, end: Column, rate) -> tuple[Column, Column]:
    """Rounded frame bounds of a time slice."""
    first = F.greatest(F.lit(0), to_frames(start, rate)).cast("bigint")
    return first, F.greatest(first, to_frames(end, rate)).cast("bigint")


def slice_time(clips: DataFrame, start: Column, end: Column, rate: int, samples: str = "samples") -> DataFrame:
    """Samples between two times; a reversed slice becomes an error row."""
    first, last = slice_bounds(start, end, rate)
    return (
        clips.withColumn("error", F.when(end < start, F.lit("end_time must be greater than or equal to start_time")))
        .withColumn("first_frame", first)
        .withColumn("last_frame", last)
        .withColumn(
            samples,
            F.when(F.col("error").isNull(), _cut(F.col(samples), F.col("first_frame"), F.col("last_frame"))),
        )
    )


def slice_from(clips: DataFrame, seconds: Column, rate: int, samples: str = "samples") -> DataFrame:
    """Samples from a time on; here the first frame is cut off, not rounded."""
    return clips.withColumn("first_frame", truncated_frame(seconds, rate)).withColumn(
        samples, _cut(F.col(samples), F.col("first_frame"), F.size(samples).cast("bigint"))
    )


def _cut(samples: Column, first: Column, last: Column) -> Column:
    start = F.least(first, F.size(samples).cast("bigint"))
    return F.slice(samples, (start + 1).cast("int"), F.greatest(last - start, F.lit(0)).cast("int"))


def slice_markers(clips: DataFrame, markers: DataFrame, key: str, samples: str = "samples") -> DataFrame:
    """Slices between consecutive markers, each an own clip.

    ``markers``: key and ``frames``, the array of marker frames of the clip.
    """
    spans = markers.select(
        key,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("frames") - 2),
                lambda k: F.struct(
                    k.cast("bigint").alias("slice_no"),
                    F.get("frames", k).alias("first_frame"),
                    F.greatest(F.get("frames", k), F.get("frames", k + 1)).alias("last_frame"),
                ),
            )
        ).alias("s"),
    ).select(key, "s.*")
    return spans.join(clips, key).withColumn(
        samples, _cut(F.col(samples), F.col("first_frame"), F.col("last_frame"))
    )


def splice(slices: DataFrame, inline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slices and inline items as alternating siblings: slice 0, item 0, slice 1, ..."""
    even = slices.withColumn("idx", F.col("slice_no") * 2).drop("slice_no")
    odd = inline.withColumn("idx", F.col("item_no") * 2 + 1).drop("item_no")
    return even.unionByName(odd, allowMissingColumns=True)


def concatenate(clips: DataFrame, keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Offset of every clip when the clips of a group follow each other without gaps."""
    return running(clips, keys, [idx], [Running("start_frame", "sum", F.col("frames"))])


def placement_report(placed: DataFrame, rate: int) -> DataFrame:
    """Report line per child with its span to the millisecond."""
    at = lambda frame: F.format_string("%.3f", to_seconds(F.col(frame), rate))
    return placed.withColumn(
        "message",
        F.concat(F.lit("places "), F.col("label"), F.lit(" from "), at("start_frame"), F.lit("s to "), at("end_frame"), F.lit("s")),
    )
