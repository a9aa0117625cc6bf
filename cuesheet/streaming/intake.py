"""Render requests as a stream: skip repeats and cached ones, number batches, append."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuesheet.operators.requests import BATCH_SIZE, cache_misses, ranked_batches
from cuesheet.session import stored
from cuesheet.sources.caches import read_cache

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_requests(spark: SparkSession, pattern: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of requests as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def _firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first request of each key among a task's rows at hand, so that a key that repeats often travels little."""
    for batch in batches:
        yield batch.sort_values("request_id", kind="stable").drop_duplicates("key")


def _new(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first request of a key that was never seen before, and nothing ever after."""
    first = None
    for batch in batches:
        # Most keys have one row here, which needs no sort.
        rows = batch if first is None else pd.concat([first, batch])
        first = rows if len(rows) == 1 else rows.iloc[[rows["request_id"].to_numpy().argmin()]]
    if not state.exists and first is not None:
        state.update((True,))
        yield first


def new_requests(requests: DataFrame) -> DataFrame:
    """Of a stream of requests the first of each key, by keyed state; the state is a key each, and never expires."""
    schema = requests.schema
    thinned = requests.mapInPandas(_firsts, schema)
    return thinned.groupBy("key").applyInPandasWithState(
        _new, schema, "taken boolean", "append", GroupStateTimeout.NoTimeout
    )


def intake(
    requests: DataFrame,
    target: str,
    checkpoint: str,
    cache_path: str | None = None,
    cache_schema: str = "key string",
    batch_size: int = BATCH_SIZE,
):
    """Start the job. Requests need ``key``, ``request_id`` (integer, registration order) and ``empty``.

    A request is never too late: no watermark drops it. Of the requests with one key the first that comes is taken in,
    by ``request_id`` in the same micro-batch. Keys are state in a key-value store beside the checkpoint, so a
    micro-batch reads its own rows, and not what earlier ones wrote, however many there were. One that runs again
    starts from the state before it and overwrites its own folder, so the sink is exactly-once. Empty requests are
    settled at once and carry no batch number. ``request_id`` may be dense or spread out.
    """
    spark = requests.sparkSession

    def settle(batch: DataFrame, epoch: int) -> None:
        # Stored once: what is new is needed several times, and the state must not be asked again.
        todo = stored(batch, "intake")
        if cache_path is not None:
            todo = stored(cache_misses(todo, read_cache(batch.sparkSession, cache_path, cache_schema)), "intake-misses")
        numbered = ranked_batches(todo.where(~F.col("empty")), ["request_id", "key"], batch_size)
        none = F.lit(None).cast("bigint")
        settled = todo.where("empty").withColumns({"batch_no": none, "pos": none})
        rows = numbered.unionByName(settled)
        rows.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            new_requests(requests)
            .writeStream.foreachBatch(settle)
            .outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def accepted(spark: SparkSession, target: str) -> DataFrame:
    """What the job has taken in so far; (epoch, batch_no) names a batch."""
    return spark.read.parquet(target)
