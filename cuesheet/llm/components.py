"""Connected components of a table of links, in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.session import stored


def compact(df: DataFrame, label: str) -> DataFrame:
    """``stored`` for a table of small rows: files of even size, as many as the rows need."""
    return stored(df.hint("rebalance"), label)


def contract(edges: DataFrame, label: str = "components", rounds: list | None = None) -> DataFrame:
    """Connected components of (a, b): (node, component), the component being its smallest node.

    Every round orders the nodes anew by a hash, points each at the least of its neighbours and itself, follows the
    pointers one step further, and rewrites the edges with their ends. Under a random order about a third of the nodes
    of a path are least among their neighbours, in whatever order the path's own ids come. All steps are joins and
    grouped minima; ``rounds`` collects the number of each round, for tests. Edges with a null end are left out.
    """
    edges = compact(edges.where("a <> b").select("a", "b").distinct(), f"{label}-edges")
    found, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        if rounds is not None:
            rounds.append(turn)

        def placed(node: str) -> Column:
            return F.struct(F.xxhash64(F.lit(turn), node).alias("place"), F.col(node).alias("node"))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(placed("b")).alias("low"))
        to = to.select(F.col("a").alias("node"), F.least("low", placed("a"))["node"].alias("to"))
        onward = to.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        to = compact(to.join(onward, "to").select("node", F.col("onward").alias("to")), f"{label}-pointers")
        if found is None:
            found = to.select("node", F.col("to").alias("end"))
        else:
            step = to.select(F.col("node").alias("end"), F.col("to").alias("next"))
            found = found.join(step, "end", "left").select("node", F.coalesce("next", "end").alias("end"))
            found = compact(found, f"{label}-found")
        ends_a = to.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        ends_b = to.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(ends_a, "a").join(ends_b, "b").where("to_a <> to_b")
        edges = edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = compact(edges, f"{label}-edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Stored before it is joined back, so that a component that holds most nodes can be split in the join.
    least = compact(found.groupBy("end").agg(F.min("node").alias("component")), f"{label}-least")
    return found.join(least, "end").select("node", "component")
