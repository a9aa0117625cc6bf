"""Placement of rows on shards by a lookup table that the shards fill by turns.

Every shard has a preference order over the slots of a table of prime size: a start and a stride, both hashes of its
name, which visit every slot once. The shards take turns, each claiming its next preferred slot that is free, until the
table is full. So shards get equally many slots (one more or less), and if one goes, mostly its own slots move. A row's
slot is a hash of its key; the table's size is fixed, so it is broadcast, and placement is one look-up per row without
a shuffle, whatever the keys' distribution.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65_537  # a prime; at least 100 times the shards keeps the shares within a percent
SHARDS = 64


def preferences(shard: str, slots: int) -> tuple[int, int]:
    """(start, stride) of a shard's order over the slots; the stride is never 0."""
    start = xxhash.xxh64_intdigest(shard, seed=1) % slots
    return start, 1 + xxhash.xxh64_intdigest(shard, seed=2) % (slots - 1)


def _is_prime(n: int) -> bool:
    return n > 2 and n % 2 == 1 and all(n % k for k in range(3, int(n**0.5) + 1, 2))


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the number of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("the table's size must be a prime, and no smaller than the number of shards")
    table = np.full(slots, -1, np.int32)
    at, stride = (list(x) for x in zip(*(preferences(s, slots) for s in shards)))
    free = slots
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + stride[k]) % slots
            table[slot] = k
            at[k] = (slot + stride[k]) % slots
            free -= 1
            if not free:
                return table


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null parts of a key do not change its hash, so rows without a key share a slot."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    names = np.array(shards, object)
    rows = list(zip(range(slots), names[fill(shards, slots)].tolist()))
    return spark.createDataFrame(rows, "slot int, shard string")


def place(rows: DataFrame, key: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """All rows and columns of ``rows`` with their slot and shard, without a shuffle.

    Columns of the same names are replaced. Equal keys, also null ones, get the same shard; an empty table stays empty.
    """
    table = F.broadcast(lookup(rows.sparkSession, shards, slots))  # always ``slots`` rows
    kept = rows.drop("slot", "shard").withColumn("slot", slot_of(*[F.col(k) for k in key], slots=slots))
    return kept.join(table, "slot")


def names(count: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(count)]


def write(rows: DataFrame, key: list[str], shards: list[str], path: str, slots: int = SLOTS) -> None:
    """One folder per shard; each task writes to the shards that its rows have, so no shard is gathered in one task."""
    place(rows, key, shards, slots).drop("slot").write.partitionBy("shard").mode("overwrite").parquet(path)
