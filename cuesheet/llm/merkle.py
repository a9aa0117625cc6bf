"""A Merkle manifest of a table: each row is a leaf, each source a tree, and a tree above the sources.

Rows of a source stand in blocks of ``BLOCK`` consecutive leaves. A task builds the part of the tree inside its block. Above
the blocks the digests travel as in a butterfly: in round r every block swaps the digest of its subtree with the 15
partners of its aligned group that stand 16^r blocks apart, and all of them hash the common parent for themselves. After
the last round every block knows the root and each sibling on its way, so nothing is sent down the tree again. The last
group of a source can be ragged: it then fills up with stand-ins, which pass its digest on and are at most as many as the
blocks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuesheet.operators.scans import attach, chunk_of
from cuesheet.session import stored

FANOUT = 16
BLOCK = FANOUT**2
TAMPER = 5  # rows whose crc32(doc_id) this divides are tampered with

_STEPS = "array<struct<left:string,right:string>>"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _value(name: str | Column) -> Column:
    value = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: str | Column = "text") -> Column:
    """Digest of a row; ``text`` may be another expression than the column."""
    return F.sha2(F.concat(*[_value(c) for c in ("doc_id", "source", "lang", "n_chars", text)]), 256)


def tampered_text() -> Column:
    """The text with A-Z in lower case, where the row is one of those to be tampered with."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0, lower).otherwise(F.col("text"))


def positions(rows: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """Adds ``pos`` (zero-based, by ``order`` within ``key``) and ``total`` (rows of the key).

    Rows are sorted over all partitions at once, so a key may hold any share of them. What one partition holds of a key
    is consecutive, and only these runs are added up.
    """
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ordered = stored(ordered.withColumn("_row", F.monotonically_increasing_id()), label)
    ordered = ordered.withColumn("_part", F.shiftright("_row", 33))
    runs = ordered.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        key, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(whole).alias("total"),
    )
    placed = ordered.join(runs, [key, "_part"])
    return placed.select(*rows.columns, (F.col("_start") + F.col("_row") - F.col("_first")).alias("pos"), "total")


def butterfly(nodes: DataFrame, key: str) -> DataFrame:
    """Adds the way up: from (key, place, places, digest) to (key, place, places, root, steps).

    ``place`` counts the key's nodes from zero, ``places`` is their number. A step has the siblings' digests left and right
    of the node. ``digest`` becomes the key's root; a key with one node keeps its digest.
    """
    state = nodes.select(key, "place", "places", "digest", F.lit(None).cast(_STEPS).alias("steps"))
    state = state.withColumn("steps", F.coalesce("steps", F.array().cast(_STEPS)))
    most = nodes.agg(F.max("places")).first()[0] or 0
    width, turn = 1, 0
    while width < most:
        wide = width * FANOUT
        group = Window.partitionBy(
            key, F.expr(f"place div {wide}L"), F.col("place") % width
        ).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        active = state.where(F.col("places") > width)
        swapped = active.withColumn("_all", F.array_sort(F.collect_list(F.struct("place", "digest")).over(group)))
        side = "array_join(transform(filter(_all, x -> x.place {} place), x -> x.digest), '')"
        swapped = swapped.withColumn(
            "steps",
            F.concat(
                "steps",
                F.array(F.struct(F.expr(side.format("<")).alias("left"), F.expr(side.format(">")).alias("right"))),
            ),
        ).withColumn("digest", F.sha2(F.expr("array_join(_all.digest, '')"), 256))
        # The last of a ragged group stands in for the places that are missing, if there is another round.
        missing = F.when(
            (F.col("places") > wide) & (F.expr("element_at(_all, -1).place") == F.col("place")),
            F.lit(FANOUT) - F.size("_all"),
        ).otherwise(0)
        copies = F.explode(F.sequence(F.lit(0), missing)).alias("_copy")
        swapped = swapped.select(key, "place", "places", "digest", "steps", copies)
        swapped = swapped.select(
            key, (F.col("place") + F.col("_copy") * F.lit(width)).alias("place"), "places", "digest",
            F.when(F.col("_copy") == 0, F.col("steps")).otherwise(F.array().cast(_STEPS)).alias("steps"),
        )
        state = swapped.unionByName(state.where(F.col("places") <= width))
        width, turn = wide, turn + 1
        if width < most:
            state = stored(state, f"merkle-round-{turn}")
    return state.where("place < places").withColumnRenamed("digest", "root")


def _levels(leaves: list[str], several: bool) -> list[list[str]]:
    """The levels of a block's subtree from its leaves up; with more blocks beside it a block has the full height."""
    levels = [leaves]
    while len(levels[-1]) > 1 or (several and len(levels) <= 2):
        own = levels[-1]
        levels.append([_hash("".join(own[k : k + FANOUT])) for k in range(0, len(own), FANOUT)])
    return levels


def _top(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    key, block, total = (rows.column(name)[0].as_py() for name in ("key", "block", "total"))
    digest = _levels(rows.column("leaf").to_pylist(), total > BLOCK)[-1][0]
    return pa.table({"key": [key], "place": [block], "places": [-(-total // BLOCK)], "digest": [digest]})


def _proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
    """Per leaf of a block: its proof, and the root folded from the leaf as it is now."""
    rows = rows.sort_by("pos")
    levels = _levels(rows.column("leaf").to_pylist(), rows.column("total")[0].as_py() > BLOCK)
    own = above.to_pylist()[0]
    upper = [(s["left"], s["right"]) for s in own["steps"]]
    upper_proof = "".join(left + right for left, right in upper)
    proofs, folded = [], []
    for k, now in enumerate(rows.column("now").to_pylist()):
        siblings = []
        for level in levels[:-1]:
            start = k - k % FANOUT
            siblings.append(("".join(level[start:k]), "".join(level[k + 1 : start + FANOUT])))
            k //= FANOUT
        proofs.append(_hash("".join(left + right for left, right in siblings) + upper_proof))
        for left, right in siblings + upper:
            now = _hash(left + now + right)
        folded.append(now)
    count = len(folded)
    return pa.table(
        {
            "doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), "subroot": [own["subroot"]] * count,
            "root": [own["root"]] * count, "proof_sha256": proofs, "folded_root": folded,
        }
    )


def manifest(documents: DataFrame, now: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``now`` is the text as it is found when the manifest is checked, an expression over the columns; the default is the
    text itself, which verifies every row. The leaf covers doc_id, source, lang, n_chars and text, each of which may be
    null. Rows of a source stand by doc_id, nulls first, and rows that repeat a doc_id by leaf; fully equal rows are leaves
    of their own. Texts may be empty or of any length. Further columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    source = F.col("source").cast("string")
    leaves = documents.select(
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("key"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf().alias("leaf"),
        (leaf() if now is None else F.when(now.eqNullSafe(F.col("text")), leaf()).otherwise(leaf(now))).alias("now"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    placed = positions(leaves, "key", ["doc_id", "leaf", "_tie"], "merkle-leaves")
    placed = placed.select("key", "doc_id", "leaf", "now", "pos", "total", F.expr(f"pos div {BLOCK}L").alias("block"))
    placed = stored(placed, "merkle-placed")

    tops = placed.select("key", "block", "pos", "total", "leaf").groupBy("key", "block")
    blocks = stored(tops.applyInArrow(_top, "key string, place long, places long, digest string"), "merkle-blocks")
    blocks = stored(butterfly(blocks, "key"), "merkle-sources")

    sources = blocks.where("place = 0").select("key", F.col("root").alias("digest"), F.lit(0).alias("all"))
    sources = positions(sources, "all", ["key"], "merkle-order")
    named = sources.select("key", F.col("pos").alias("source_place"))
    tree = sources.select("all", F.col("pos").alias("place"), F.col("total").alias("places"), "digest")
    tree = stored(butterfly(tree, "all").join(named.withColumnRenamed("source_place", "place"), "place"), "merkle-root")

    above = attach(
        blocks.withColumnRenamed("root", "subroot").withColumnRenamed("steps", "below"),
        tree.select("key", "root", F.col("steps").alias("over")),
        ["key"],
        chunk_of("place"),
    )
    above = above.select("key", F.col("place").alias("block"), "subroot", "root", F.concat("below", "over").alias("steps"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proven = placed.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(_proofs, schema)
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
