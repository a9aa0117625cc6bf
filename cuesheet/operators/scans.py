"""Running measures over ordered groups of any size.

``Window.partitionBy(key).orderBy(ordinal)`` puts a whole key into one task. Here a key may hold a
third of all rows, so each key is cut into chunks of consecutive ordinals:

1. partial aggregates per (key, chunk), combined on the map side;
2. a window over the chunk table only, which is smaller by the chunk size;
3. the rows run a window inside the chunk and join its carry on (key, chunk).

Rows shuffle once, on (key, chunk), which no single key can overload. A chunk is a monotone function
of the order, ``ordinal div n``: with unique integer ordinals it holds at most ``n`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuesheet.session import stored

CHUNK = "_chunk"
CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class Running:
    """One running measure.

    kind: ``sum`` and ``max`` look back; ``last`` carries the last non-null value forward; ``next``
    carries the next non-null value backward; ``total`` is the sum over the whole key.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = False


def chunk_of(ordinal: str | Column, rows: int = CHUNK_ROWS) -> Column:
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.call_function("div", ordinal.cast("bigint"), F.lit(rows).cast("bigint"))


def _value(measure: Running) -> str:
    return f"_v_{measure.name}"


def _carry(measure: Running) -> str:
    return f"_c_{measure.name}"


def _partial(measure: Running, order: Sequence[str]) -> Column:
    value = F.col(_value(measure))
    if measure.kind in ("sum", "total"):
        partial = F.sum(value)
    elif measure.kind == "max":
        partial = F.max(value)
    else:
        position = F.when(value.isNotNull(), F.struct(*order))
        pick = F.max_by if measure.kind == "last" else F.min_by
        partial = pick(value, position)
    return partial.alias(_carry(measure))


def _carried(measure: Running, keys: Sequence[str]) -> Column:
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    after = chunks.rowsBetween(1, Window.unboundedFollowing)
    partial = F.col(_carry(measure))
    carried = {
        "sum": lambda: F.sum(partial).over(before),
        "max": lambda: F.max(partial).over(before),
        "last": lambda: F.last(partial, ignorenulls=True).over(before),
        "next": lambda: F.first(partial, ignorenulls=True).over(after),
        "total": lambda: F.sum(partial).over(Window.partitionBy(*keys)),
    }[measure.kind]()
    return carried.alias(_carry(measure))


def _local(measure: Running, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The measure over the rows of its chunk alone."""
    value = F.col(_value(measure))
    rows = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    before = rows.rowsBetween(Window.unboundedPreceding, 0 if measure.inclusive else -1)
    after = rows.rowsBetween(0 if measure.inclusive else 1, Window.unboundedFollowing)
    local = {
        "sum": lambda: F.sum(value).over(before),
        "max": lambda: F.max(value).over(before),
        "last": lambda: F.last(value, ignorenulls=True).over(before),
        "next": lambda: F.first(value, ignorenulls=True).over(after),
    }
    return local[measure.kind]().alias(_value(measure))


def _combined(measure: Running) -> Column:
    local, carry = F.col(_value(measure)), F.col(_carry(measure))
    if measure.kind == "sum":
        zero = F.lit(0)
        combined = F.coalesce(carry, zero) + F.coalesce(local, zero)
    elif measure.kind == "max":
        combined = F.greatest(carry, local)
    elif measure.kind in ("last", "next"):
        combined = F.coalesce(local, carry)
    else:
        combined = carry
    return combined.alias(measure.name)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Sequence[Running],
    chunk: Column | None = None,
) -> DataFrame:
    """Add running measures. ``keys`` must not be null; ``chunk`` defaults to the first order column."""
    chunk = chunk_of(order[0]) if chunk is None else chunk
    columns = df.columns
    rows = df.select(
        *columns, *[m.value.alias(_value(m)) for m in measures], chunk.alias(CHUNK)
    )
    carries = (
        rows.groupBy(*keys, CHUNK)
        .agg(*[_partial(m, order) for m in measures])
        .select(*keys, CHUNK, *[_carried(m, keys) for m in measures])
    )
    # The window comes first: its sort also serves the join, which would otherwise sort all rows once more.
    inside = rows.select(*columns, CHUNK, *[_local(m, keys, order) for m in measures if m.kind != "total"])
    return inside.join(carries, [*keys, CHUNK]).select(*columns, *[_combined(m) for m in measures])


def salt(*columns: str | Column, parts: int = 64) -> Column:
    """Chunk for ``attach`` where rows have no ordinal: a hash of what tells rows of one key apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("bigint")


def is_bounded(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows, looked up before it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def attach(
    df: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    how: str = "inner",
) -> DataFrame:
    """Join one row per key onto rows whose keys may be hot.

    The per-key rows are repeated once for each chunk the key has, and the join runs on (key, chunk).
    """
    rows = df.withColumn(CHUNK, chunk)
    spread = rows.select(*keys, CHUNK).distinct().join(facts, list(keys))
    return rows.join(spread, [*keys, CHUNK], how).drop(CHUNK)


def global_position(df: DataFrame, major: str, minor: Sequence[str], name: str = "position") -> DataFrame:
    """Zero-based position over (major, minor...), whatever values these have.

    Rows are dealt to tasks by sampled ranges, so ids may be dense or spread out, and sorted and stored there. Only how many
    rows each task has is summed up in one place: the window has as many rows as there are tasks.
    """
    columns, order = df.columns, [major, *minor]
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id counts rows inside a partition below bit 33.
    placed = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(starts, "_part")
    return numbered.select(*columns, (F.col("_before") + row).cast("bigint").alias(name))
