"""Session helpers: local sessions for tests and the bench, and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_FOLDERS: dict[str, str] = {}


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "cuesheet") -> SparkSession:
    """A single-machine session. On a cluster the caller brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a cluster that would be one machine's.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors of {master} can reach")
        application = spark.sparkContext.applicationId
        if application not in _OWN_FOLDERS:
            _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="cuesheet-")
        folder = _OWN_FOLDERS[application]
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/cuesheet/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never forces a long recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write a stage's table to the shared folder once and read it back.

    Later stages scan it several times with few columns, instead of repeating the work behind it. ``release`` drops the
    shuffle files of that work as soon as the table is written; otherwise they stay until the driver collects garbage.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true" if release else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)
