"""Recogniser output: JSON segments to clause and word arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = "struct<word: string, start: double, end: double, score: double>"
SEGMENTS = f"array<struct<text: string, start: double, end: double, words: array<{WORD}>>>"
SCHEMA = f"language string, segments {SEGMENTS}"


def read_asr(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per JSON file, with its path."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(pattern).select(
        F.input_file_name().alias("path"), "language", "segments"
    )


def parse(json: Column) -> Column:
    """Segments of a JSON text."""
    return F.from_json(json, SCHEMA)["segments"]


def clauses(segments: Column) -> Column:
    """Clause per segment; missing times stay null."""
    return F.transform(
        F.coalesce(segments, F.expr(f"cast(array() as {SEGMENTS})")),
        lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), s["start"].alias("start"), s["end"].alias("end")),
    )


def words(segments: Column) -> Column:
    """Words of all segments in order; a segment without words adds none."""
    no_words = F.expr(f"cast(array() as array<{WORD}>)")
    return F.flatten(
        F.transform(
            segments,
            lambda s: F.transform(
                F.coalesce(s["words"], no_words),
                lambda w: F.struct(F.coalesce(w["word"], F.lit("")).alias("text"), w["start"].alias("start"), w["end"].alias("end")),
            ),
        )
    )
