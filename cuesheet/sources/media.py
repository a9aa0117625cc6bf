"""Listings of voice and sound files. Only paths are read, never the contents; empty files do not count."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuesheet.operators.assets import supported


# Scheme and authority of a path, such as file://, s3a://bucket or hdfs://host:8020.
_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*"


def _listing(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    # `content` is pruned: the plan reads file status only.
    return reader.load(folder).select(F.regexp_replace("path", _STORE, "/").alias("path"), "length")


def _absolute(spark: SparkSession, folder: str) -> str:
    """The folder as the file system it lies in names it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString()


def voice_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one folder level, of any kind: a voice may name a file directly."""
    return _listing(spark, folder, False)


def sound_files(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files below a folder, with paths relative to it."""
    # Listed paths are absolute, whatever form the folder has; both lose the store's name.
    prefix = re.sub(_STORE, "/", _absolute(spark, folder)).rstrip("/") + "/"
    found = _listing(spark, folder, True)
    relative = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    return supported(found.where(F.col("path").startswith(prefix)).select(relative.alias("path"), "length"))
