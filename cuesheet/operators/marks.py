"""Named marks that bubble up a plan tree, and cutting everything before one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.operators.scans import CHUNK_ROWS, Running, attach, chunk_of, running
from cuesheet.session import cut_lineage

CHECKPOINT_LEVELS = 3


def visible(shown: DataFrame, keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Marks a container shows: those exactly one direct child shows.

    Input: one row per (keys, child, mark). ``idx`` is the child's position. Counts combine on the
    map side, so a container with any number of children is fine.
    """
    counted = shown.groupBy(*keys, "mark").agg(F.count(F.lit(1)).alias("n"), F.min(idx).alias(idx))
    return counted.where("n = 1").drop("n")


def ordered(visible_: DataFrame, keys: Sequence[str], idx: str = "idx") -> DataFrame:
    """Number the visible marks of each container by first appearance."""
    return running(visible_, keys, [idx, "mark"], [Running("mark_no", "sum", F.lit(1).cast("bigint"))])


def bubble(nodes: DataFrame, marks: DataFrame, max_depth: int) -> DataFrame:
    """Visible marks of every container, bottom-up over the depth of the tree.

    ``nodes``: production, node_id, parent_id, depth, idx. ``marks``: production, node_id, mark.
    Returns production, node_id, depth, mark, idx (of the child that shows it) and child_id.
    """
    below: DataFrame | None = None
    levels: list[DataFrame] = []
    for depth in range(max_depth, 0, -1):
        level = nodes.where(F.col("depth") == depth).select("production", "node_id", "parent_id", "idx")
        own = level.join(marks, ["production", "node_id"])
        if below is not None:
            risen = level.join(below.select("production", "node_id", "mark"), ["production", "node_id"])
            own = own.unionByName(risen)
        counted = own.groupBy("production", "parent_id", "mark").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("idx", "node_id")).alias("c")
        )
        below = counted.where("n = 1").select(
            "production",
            F.col("parent_id").alias("node_id"),
            F.lit(depth - 1).alias("depth"),
            "mark",
            F.col("c.idx").alias("idx"),
            F.col("c.node_id").alias("child_id"),
        )
        if (max_depth - depth) % CHECKPOINT_LEVELS == CHECKPOINT_LEVELS - 1:
            below = cut_lineage(below)
        levels.append(below)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def cut_before(
    rows: DataFrame, visible_: DataFrame, targets: DataFrame, keys: Sequence[str], idx: str = "idx", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Children of flat containers from the one that shows the target mark on.

    Containers without a target keep everything; an unknown target is reported by ``cut_errors``.
    """
    bounds = targets.join(visible_, [*keys, "mark"]).select(*keys, F.col(idx).alias("_from"))
    cut = attach(rows, bounds, keys, chunk_of(idx, chunk_rows), "left")
    return cut.where(F.col("_from").isNull() | (F.col(idx) >= F.col("_from"))).drop("_from")


def cut_errors(visible_: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets their container does not show."""
    missing = targets.join(visible_.select(*keys, "mark"), [*keys, "mark"], "left_anti")
    return missing.withColumn(
        "message", F.concat(F.lit("Unknown or ambiguous audio mark '"), F.col("mark"), F.lit("'"))
    )


def cut_tree(nodes: DataFrame, bubbled: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """Nodes left after cutting each production before its target mark.

    At every level on the way to the mark, earlier siblings go, with all below them.
    """
    keys = ["production", "parent_id"]
    wanted = targets.join(bubbled, ["production", "mark"])
    alive = nodes.where("depth = 0")
    kept = [alive]
    path = wanted.where("depth = 0").select("production", "node_id", "idx", "child_id")
    for depth in range(1, max_depth + 1):
        level = nodes.where(F.col("depth") == depth)
        parents = alive.select("production", F.col("node_id").alias("parent_id"))
        bounds = path.select("production", F.col("node_id").alias("parent_id"), F.col("idx").alias("_from"))
        facts = parents.join(bounds, keys, "left")
        alive = (
            attach(level, facts, keys, chunk_of("idx"))
            .where(F.col("_from").isNull() | (F.col("idx") >= F.col("_from")))
            .drop("_from")
            .select(*nodes.columns)
        )
        if depth % CHECKPOINT_LEVELS == 0 and depth < max_depth:
            alive = cut_lineage(alive)
        kept.append(alive)
        steps = path.select("production", F.col("child_id").alias("node_id"))
        path = steps.join(wanted.where(F.col("depth") == depth), ["production", "node_id"]).select(
            "production", "node_id", "idx", "child_id"
        )
    left = kept[0]
    for level in kept[1:]:
        left = left.unionByName(level)
    return left


def surviving_requests(requests: DataFrame, survivors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests of scripts that are still there; run before anything costly."""
    return requests.join(survivors.select(*keys).distinct(), list(keys), "left_semi")


def mark_of(json: Column) -> Column:
    return F.get_json_object(json, "$.k")
