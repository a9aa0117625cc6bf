"""Small helpers for stages that run on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in small slices, so that a stage's own arrays stay small beside a batch of long texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_slice(make: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A function for ``mapInArrow`` that applies ``make`` to each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield make(part)

    return run


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Jobs that run inside exchange batches of so many rows with Python: for rows that hold whole sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
