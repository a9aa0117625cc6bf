"""Debug lines and artifact files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cuesheet.functions import text as T
from cuesheet.operators.scans import global_position
from cuesheet.settings import DEBUG_CATEGORIES
from cuesheet.sources.parts import SCHEMA, write_parts
from cuesheet.sources.wav import write_wavs


def debug_lines(messages: DataFrame, enabled: Sequence[str]) -> DataFrame:
    """``[category] message`` lines of the enabled categories."""
    unknown = set(enabled) - set(DEBUG_CATEGORIES)
    if unknown:
        raise ValueError(f"Unknown debug category {sorted(unknown)[0]!r}")
    kept = messages.where(F.col("category").isin(*enabled)) if enabled else messages.where(F.lit(False))
    return kept.withColumn("line", F.concat(F.lit("["), "category", F.lit("] "), "message"))


def unknown_categories(messages: DataFrame) -> DataFrame:
    return messages.where(~F.col("category").isin(*DEBUG_CATEGORIES))


def write_debug_lines(lines: DataFrame, path: str) -> None:
    """Replace the log: one folder per category."""
    lines.select("category", "line").write.mode("overwrite").partitionBy("category").text(path)


def artifact_names(
    requests: DataFrame, major: str, minor: Sequence[str], label: Column, fallback: str, extension: str
) -> DataFrame:
    """Numbered file names ``NNN-label.ext`` in registration order."""
    numbered = global_position(requests, major, minor, "_no")
    name = F.concat(
        F.format_string("%03d", F.col("_no")), F.lit("-"), T.file_label(label, fallback), F.lit(f".{extension}")
    )
    return numbered.withColumn("file_name", name).drop("_no")


def json_parts(named: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Each row's payload columns as a JSON file of its own, indented and with sorted keys, for ``write_parts``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, cell in zip(batch["file_name"], batch["json"]):
                content = (json.dumps(json.loads(cell), indent=2, sort_keys=True) + "\n").encode()
                rows.append((path, 0, content, len(content)))
            yield pd.DataFrame(rows, columns=["path", "at", "content", "size"])

    cells = F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})
    return named.select("file_name", cells.alias("json")).mapInPandas(encode, SCHEMA)


def write_artifacts(named: DataFrame, payload: Sequence[str], folder: str) -> None:
    """The payload of every artifact as a file of its name."""
    write_parts(json_parts(named, payload), folder)


def write_wav_artifacts(named: DataFrame, folder: str, rate: int) -> None:
    """Audio artifacts: blocks of clips with the clip's ``file_name``, as float files of that name."""
    write_wavs(named.withColumnRenamed("file_name", "path"), folder, rate, True)
