"""From a placed plan tree to audio: blocks are cut, moved, mixed and treated without a clip ever being one row.

A *move* takes frames [first, last) of a clip to frame ``at`` of another one. It meets just the blocks that it overlaps,
by a join on (clip, block); what it takes of a block is a piece, and pieces are cut at the target's block edges and
summed. Slicing, splicing, joining lines, mixing and trimming are all moves.

A container with a preset is a *bus*: what lies in it is mixed to the bus, the bus is treated as a clip of its own, and the
treated clip is moved into the next bus around it, or into the production. Containers without a preset only place, so
their contents go straight to the bus around them: audio is shuffled once for each layer of presets, not for each level of
the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.functions.timing import truncated_frame
from cuesheet.operators import blocks as B
from cuesheet.operators.scans import Running, attach, chunk_of, running, salt
from cuesheet.operators.timeline import slice_bounds
from cuesheet.session import stored


def pieces(blocks: DataFrame, moves: DataFrame, keys: Sequence[str], block_frames: int) -> DataFrame:
    """What moves take of the blocks they overlap: (keys, start_frame, l, r), in frames of the target.

    ``moves``: clip_id, first, last, at and the target's ``keys``. A clip may be moved any number of times; frames that a
    clip lacks give nothing.
    """
    last_block = chunk_of(F.col("last") - 1, block_frames)
    spread = moves.where("last > first").select(
        "*", F.explode(F.sequence(chunk_of("first", block_frames), last_block)).alias("block_no")
    )
    own = blocks.select("clip_id", "block_no", F.col("start_frame").alias("_begin"), "l", "r")
    # One sound may be moved to a third of all places.
    met = attach(spread, own, ["clip_id", "block_no"], salt(*keys, "at", "first"))
    low = F.greatest(F.col("first"), F.col("_begin"))
    high = F.least(F.col("last"), F.col("_begin") + F.size("l"))
    cut = lambda name: F.slice(name, (low - F.col("_begin") + 1).cast("int"), (high - low).cast("int")).alias(name)
    return met.where(high > low).select(
        *keys, (F.col("at") + low - F.col("first")).cast("bigint").alias("start_frame"), cut("l"), cut("r")
    )


def join_pieces(found: DataFrame, lengths: DataFrame, block_frames: int, keep: Sequence[str] = ()) -> DataFrame:
    """Blocks of the clips that pieces make: sums where they overlap, zeros where nothing sounds.

    ``found``: clip_id, start_frame, l, r. ``lengths``: clip_id, frames; clips without frames have no blocks. ``keep``
    names columns of ``lengths`` that come along.
    """
    mixed = B.mix_blocks(found, ["clip_id"], block_frames, channels=("l", "r"))
    filled = B.fill_silence(mixed, lengths, ["clip_id"], block_frames, ("l", "r"), ("frames", *keep))
    begin = F.col("block_no") * block_frames
    size = F.least(F.lit(block_frames), F.col("frames") - begin).cast("int")
    return filled.select(
        "clip_id", "block_no", begin.alias("start_frame"), F.col("frames").alias("total"),
        F.slice("l", 1, size).cast("array<float>").alias("l"), F.slice("r", 1, size).cast("array<float>").alias("r"),
        *keep,
    )


def move(blocks: DataFrame, moves: DataFrame, lengths: DataFrame, block_frames: int) -> DataFrame:
    """Blocks of new clips, made of moved parts of others. ``moves``: clip_id, target, first, last, at."""
    found = pieces(blocks, moves, ["target"], block_frames).withColumnRenamed("target", "clip_id")
    return join_pieces(found, lengths, block_frames)


def lengths_of(blocks: DataFrame) -> DataFrame:
    """(clip_id, frames) of blocks."""
    return blocks.groupBy("clip_id").agg(F.max("total").cast("bigint").alias("frames"))


def slice_moves(slices: DataFrame, blocks: DataFrame, rate: int) -> DataFrame:
    """Moves for time slices (clip_id, target, start, end; end null: to the clip's end): (clip_id, target, first, last, at).

    Both times are rounded to frames, but a slice without an end begins at its time cut off to a frame. Reversed slices
    are errors and are left out (``slice_problems``). What lies past the clip's end is not there.
    """
    open_, from_ = F.col("end").isNull(), truncated_frame(F.col("start"), rate)
    first, last = slice_bounds(F.col("start"), F.col("end"), rate)
    known = attach(slices.where("end is null OR end >= start"), lengths_of(blocks), ["clip_id"], salt("target", "start"))
    inside = lambda frame: F.least(frame, F.col("frames"))
    return known.select(
        "clip_id", "target",
        inside(F.when(open_, from_).otherwise(first)).cast("bigint").alias("first"),
        inside(F.when(open_, F.col("frames")).otherwise(last)).cast("bigint").alias("last"),
        F.lit(0).cast("bigint").alias("at"),
    )


def slice_problems(slices: DataFrame) -> DataFrame:
    """Reversed time slices: (clip_id, target, message)."""
    message = F.lit("end_time must be greater than or equal to start_time")
    return slices.where("end < start").select("clip_id", "target", message.alias("message"))


def slice_blocks(blocks: DataFrame, slices: DataFrame, rate: int, block_frames: int) -> DataFrame:
    """Time slices as clips of their own, cut from blocks; ``slices`` as for ``slice_moves``."""
    moves = slice_moves(slices, blocks, rate)
    lengths = moves.select(F.col("target").alias("clip_id"), (F.col("last") - F.col("first")).alias("frames"))
    return move(blocks, moves, lengths, block_frames)


def marker_parts(markers: DataFrame) -> DataFrame:
    """Parts between markers (clip_id, target, frames array), for ``chain``: part k has idx 2 k, which leaves room between."""
    spans = F.transform(
        F.sequence(F.lit(0), F.size("frames") - 2),
        lambda k: F.struct(
            (k * 2).cast("bigint").alias("idx"),
            F.get("frames", k).cast("bigint").alias("first"),
            F.greatest(F.get("frames", k), F.get("frames", k + 1)).cast("bigint").alias("last"),
        ),
    )
    return markers.where(F.size("frames") > 1).select("clip_id", "target", F.explode(spans).alias("s")).select(
        "clip_id", "target", "s.*"
    )


def chain(blocks: DataFrame, parts: DataFrame, block_frames: int) -> DataFrame:
    """Clips that are parts of others one after the other: spliced scripts, or the lines of a script.

    ``parts``: clip_id, target, idx (unique in the target), first, last. Offsets are running sums, so a target may have
    any number of parts.
    """
    sized = parts.where("last > first").withColumn("_size", F.col("last") - F.col("first"))
    placed = running(
        sized, ["target"], ["idx"], [Running("at", "sum", F.col("_size"))]
    )
    lengths = sized.groupBy(F.col("target").alias("clip_id")).agg(F.sum("_size").alias("frames"))
    moves = placed.select("clip_id", "target", "first", "last", F.col("at").cast("bigint").alias("at"))
    return move(blocks, moves, lengths, block_frames)


def join_lines(blocks: DataFrame, lines: DataFrame, block_frames: int) -> DataFrame:
    """Script clips from their lines' clips. ``lines``: clip_id (of the line's clip), target (the script), line_no."""
    whole = attach(lines, lengths_of(blocks), ["clip_id"], salt("target", "line_no"))
    parts = whole.select(
        "clip_id", "target", F.col("line_no").cast("bigint").alias("idx"),
        F.lit(0).cast("bigint").alias("first"), F.col("frames").alias("last"),
    )
    return chain(blocks, parts, block_frames)


def trimmed(moves: DataFrame) -> DataFrame:
    """Moves into productions, cut at their boundary: trim_start, trim_end and lead_frames are on the rows."""
    cut = F.greatest(F.lit(0), F.col("trim_start") - F.col("at"))
    first = F.col("first") + cut
    return moves.select(
        "clip_id", "target",
        first.alias("first"),
        F.least(F.col("last"), F.col("first") + F.col("trim_end") - F.col("at")).alias("last"),
        (F.col("at") + cut - F.col("trim_start") + F.col("lead_frames")).alias("at"),
    )


def buses(placements: DataFrame, max_depth: int) -> DataFrame:
    """Adds to placed nodes (depth 1 and below) the bus around each: bus, bus_start and layer.

    ``bus`` is the nearest container above that has a preset, null if there is none; ``layer`` counts those above. The
    loop runs over depth, like the placing before it.
    """
    keys = ["production", "parent_id"]
    levels: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        level = placements.where(F.col("depth") == depth)
        if not levels:
            level = level.withColumns(
                {"bus": F.lit(None).cast("string"), "bus_start": F.lit(0).cast("bigint"), "layer": F.lit(0)}
            )
        else:
            own = F.col("preset").isNotNull()
            above = levels[-1].where("is_container").select(
                "production",
                F.col("node_id").alias("parent_id"),
                F.when(own, F.col("node_id")).otherwise(F.col("bus")).alias("bus"),
                F.when(own, F.col("abs_start")).otherwise(F.col("bus_start")).alias("bus_start"),
                (F.col("layer") + own.cast("int")).alias("layer"),
            )
            level = attach(level, above, keys, chunk_of("idx"))
        levels.append(stored(level, "bus-level"))
    union = levels[0]
    for level in levels[1:]:
        union = union.unionByName(level)
    return union


def _bus_id(node: str) -> Column:
    return F.to_json(F.struct("production", F.col(node).alias("bus")))


def mix_tree(
    placements: DataFrame,
    productions: DataFrame,
    blocks: DataFrame,
    treat: Callable[[DataFrame], DataFrame],
    max_depth: int,
    block_frames: int,
) -> DataFrame:
    """Audio of whole productions as blocks, trimmed at their boundaries; ``clip_id`` is the production.

    ``placements``: as ``timeline.compose_tree`` gives them, with ``preset``, and for leaves with ``clip_id`` and ``first``,
    the clip and the frame in it with which they begin. ``productions``: as ``timeline.trim_to_boundary`` gives them.
    ``treat`` takes blocks with the column ``preset`` and returns them treated. A preset hears the mix of what its node
    holds and nothing of the gaps around it, and does not move anything.
    """
    placed = buses(placements, max_depth)
    none = F.col("preset").isNull()
    into = F.when(F.col("bus").isNotNull(), _bus_id("bus"))
    outward = F.col("abs_start") - F.col("bus_start")
    frames = F.col("frames")
    # A leaf with a preset is a bus of its own.
    leaves = placed.where("NOT is_container AND frames > 0").select(
        "production", "clip_id",
        F.when(none, into).otherwise(_bus_id("node_id")).alias("target"),
        F.when(none, F.col("layer")).otherwise(F.col("layer") + 1).alias("layer"),
        F.col("first").cast("bigint").alias("first"), (F.col("first") + frames).cast("bigint").alias("last"),
        F.when(none, outward).otherwise(F.lit(0)).cast("bigint").alias("at"),
    )
    own = placed.where("preset is not null AND frames > 0").select(
        "production", _bus_id("node_id").alias("clip_id"), into.alias("target"), "layer", "preset", "frames",
        F.lit(0).cast("bigint").alias("first"), frames.cast("bigint").alias("last"), outward.cast("bigint").alias("at"),
    )
    leaves, own = stored(leaves, "bus-leaves"), stored(own, "buses")
    deepest = own.agg(F.max("layer")).first()[0]
    treated = None
    plain = ["production", "clip_id", "target", "first", "last", "at"]

    def arriving(layer: int) -> list[tuple[DataFrame, DataFrame]]:
        """Moves into buses of a layer (0: the productions), and the blocks they are taken from."""
        found = [(blocks, leaves.where(F.col("layer") == layer).select(*plain))]
        if treated is not None:
            found.append((treated, own.where(F.col("layer") == layer).select(*plain)))
        return found

    def taken(sources: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        made = [pieces(audio, moves, ["target"], block_frames) for audio, moves in sources]
        made = made[0] if len(made) == 1 else made[0].unionByName(made[1])
        return made.withColumnRenamed("target", "clip_id")

    for layer in range(0 if deepest is None else deepest + 1, 0, -1):
        inside = own.where(F.col("layer") == layer - 1).select("clip_id", "frames", "preset")
        # Stored, as each preset of the treatment scans it.
        mixed = stored(join_pieces(taken(arriving(layer)), inside, block_frames, ("preset",)), f"bus-mix-{layer}")
        treated = stored(treat(mixed), f"bus-audio-{layer}")
    bounds = productions.select("production", "trim_start", "trim_end", "lead_frames", "final_frames")
    final = []
    for audio, moves in arriving(0):
        bounded = attach(moves, bounds, ["production"], salt("clip_id", "at"))
        final.append((audio, trimmed(bounded.withColumn("target", F.col("production")))))
    lengths = bounds.select(F.col("production").alias("clip_id"), F.col("final_frames").alias("frames"))
    return join_pieces(taken(final), lengths, block_frames)


def by_chain(chains: dict[str, B.Local], block_frames: int) -> Callable[[DataFrame], DataFrame]:
    """A ``treat`` for a catalog of own local stages by preset name; other names pass untreated."""
    plain = ["clip_id", "block_no", "start_frame", "total", "l", "r"]

    def treat(named: DataFrame) -> DataFrame:
        done = named.where(~F.col("preset").isin(*chains)).select(*plain)
        for name, stage in chains.items():
            mine = named.where(F.col("preset") == name).select(*plain)
            done = done.unionByName(B.run_stage(mine, stage, block_frames))
        return done

    return treat
