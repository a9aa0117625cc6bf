"""Cache tables keyed by a digest: render metadata and aligned positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from cuesheet.operators.requests import cache_misses

RENDER_SCHEMA = "key string, sample_rate int, frame_count bigint"
ALIGN_SCHEMA = "key string, start_positions array<double>"


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def append_cache(entries: DataFrame, path: str, schema: str) -> None:
    """Append entries whose key is new, so that appending twice changes nothing."""
    spark = entries.sparkSession
    fresh = cache_misses(entries.dropDuplicates(["key"]), read_cache(spark, path, schema))
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    fresh.select(*names).write.mode("append").parquet(path)
