"""From authored script parts to contents, speaker turns and normalised scripts.

A *part* is one ordered child of a script: a text run or an inline audio item. Parts are rows, so a
script of any length is spread over many tasks; only one part's text is ever handled as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuesheet.functions import text as T
from cuesheet.operators.scans import Running, attach, chunk_of, running

PART_ROWS = 4_096
BLOCK_LINES = 1_000


def dialogue_lines(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per non-blank line and per inline item, with the stanza it belongs to.

    Input: keys, ``ordinal``, ``kind`` ('text' or 'audio'), ``text``, ``label`` and ``speakers``
    (array of known speaker keys). A known speaker line or an inline item opens a new item; lines
    in front of the first opener have item 0.
    """
    raw = parts.select(
        *keys,
        "ordinal",
        "kind",
        "label",
        "speakers",
        F.posexplode(
            F.when(F.col("kind") == "audio", F.array(F.lit(""))).otherwise(T.split_lines(F.col("text")))
        ).alias("line_no", "raw"),
    )
    stripped = raw.select("*", T.strip(F.col("raw")).alias("line")).where(
        (F.col("kind") == "audio") | (F.col("line") != "")
    )
    named = stripped.withColumn("name", T.speaker_name(F.col("line")))
    known = F.array_contains("speakers", T.speaker_key(F.col("name")))
    is_speaker = (F.col("kind") == "text") & F.coalesce(known, F.lit(False))
    lines = named.select(
        *keys,
        "ordinal",
        "line_no",
        "kind",
        "label",
        F.when(is_speaker, T.speaker_key(F.col("name"))).alias("speaker_key"),
        F.when(is_speaker, T.after_colon(F.col("line"))).otherwise(F.col("line")).alias("piece"),
    )
    opener = F.col("speaker_key").isNotNull() | (F.col("kind") == "audio")
    return running(
        lines,
        keys,
        ["ordinal", "line_no"],
        [Running("item", "sum", F.when(opener, F.lit(1)).otherwise(F.lit(0)).cast("bigint"), True)],
        chunk_of("ordinal", PART_ROWS),
    )


def items(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold the lines of each item; a turn's text is one cell of the result.

    Text before the first speaker or inline item, item 0, is counted but not strung together: nobody reads it.
    """
    ordered = "listagg(piece, ' ') WITHIN GROUP (ORDER BY ordinal, line_no)"
    return lines.groupBy(*keys, "item").agg(
        F.max(F.when(F.col("kind") == "audio", F.lit("audio"))).alias("audio"),
        F.max("speaker_key").alias("speaker_key"),
        F.max("label").alias("label"),
        F.count(F.when((F.col("kind") == "text") & (F.col("piece") != ""), 1)).alias("n_lines"),
        F.expr(f"{ordered} FILTER (WHERE kind = 'text' AND piece <> '' AND item > 0)").alias("spoken_text"),
        F.count(
            F.when((F.col("kind") == "text") & F.col("speaker_key").isNull(), 1)
        ).alias("n_continued"),
    )


def turns(folded: DataFrame) -> DataFrame:
    """Speaker turns with text; empty ones are dropped."""
    return folded.where(F.col("speaker_key").isNotNull() & (F.col("n_lines") > 0))


def stray_text(folded: DataFrame) -> DataFrame:
    """Items whose text has no speaker: before the first speaker line, or after an inline item."""
    return folded.where(
        F.col("speaker_key").isNull() & (F.col("n_continued") > 0)
    )


def contents(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns and inline items of a script in order, numbered from 0."""
    kept = folded.where(
        F.col("audio").isNotNull() | (F.col("speaker_key").isNotNull() & (F.col("n_lines") > 0))
    )
    spoken = F.col("audio").isNull()
    numbered = running(kept, keys, ["item"], [Running("content_idx", "sum", F.lit(1).cast("bigint"))])
    return numbered.select(
        *keys,
        "content_idx",
        F.when(spoken, F.lit("line")).otherwise(F.lit("audio")).alias("kind"),
        F.when(spoken, F.col("speaker_key")).alias("speaker_key"),
        F.when(spoken, F.col("spoken_text")).alias("spoken_text"),
        F.when(~spoken, F.col("label")).alias("label"),
    )


def speakers(contents_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Speakers of each script by first appearance, numbered from 1.

    A script has no more speakers than its speaker map has entries, so the window stays small.
    """
    first = (
        contents_.where(F.col("kind") == "line")
        .groupBy(*keys, "speaker_key")
        .agg(F.min("content_idx").alias("first_idx"))
    )
    order = Window.partitionBy(*keys).orderBy("first_idx")
    return first.select(*keys, "speaker_key", F.row_number().over(order).cast("bigint").alias("speaker_no"))


def normalized_lines(contents_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``Speaker n: text`` rows of each script, numbered from 0 over its spoken lines."""
    spoken = contents_.where(F.col("kind") == "line").select(
        *keys, "content_idx", "speaker_key", "spoken_text"
    )
    numbered = attach(
        spoken, speakers(contents_, keys), [*keys, "speaker_key"], chunk_of("content_idx")
    )
    placed = running(numbered, keys, ["content_idx"], [Running("line_no", "sum", F.lit(1).cast("bigint"))])
    line = F.concat(F.lit("Speaker "), F.col("speaker_no").cast("string"), F.lit(": "), F.col("spoken_text"))
    return placed.select(*keys, "line_no", "speaker_no", "speaker_key", T.straight_quotes(line).alias("line"))


def script_blocks(lines: DataFrame, keys: Sequence[str], block_lines: int = BLOCK_LINES) -> DataFrame:
    """Normalised script text in blocks of bounded size; joined with newlines they are the script."""
    return lines.groupBy(*keys, chunk_of("line_no", block_lines).alias("block_no")).agg(
        F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY line_no)").alias("normalized_script"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def parse_normalized(scripts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of normalised scripts with their speaker number, or an error.

    Input: keys, ``normalized_script`` and ``n_voices``.
    """
    exploded = scripts.select(
        *keys, "n_voices", F.posexplode(T.split_lines(F.col("normalized_script"))).alias("pos", "raw")
    )
    lines = exploded.select(*keys, "n_voices", "pos", T.strip(F.col("raw")).alias("line")).where("line <> ''")
    pattern = "(?s)^Speaker\\s+([0-9]+)\\s*:\\s*(.+)$"
    number = F.regexp_extract("line", pattern, 1)
    parsed = lines.select(
        *keys,
        F.col("pos").cast("bigint").alias("pos"),
        "n_voices",
        F.nullif(number, F.lit("")).try_cast("bigint").alias("speaker_no"),
        F.nullif(T.strip(F.regexp_extract("line", pattern, 2)), F.lit("")).alias("text"),
        "line",
    )
    outside = (F.col("speaker_no") < 1) | (F.col("speaker_no") > F.col("n_voices"))
    error = (
        F.when(F.col("speaker_no").isNull(), F.concat(F.lit("Unsupported normalized script line: "), "line"))
        .when(
            outside,
            F.concat(
                F.lit("Speaker index "),
                F.col("speaker_no").cast("string"),
                F.lit(" is outside the available voice sample range"),
            ),
        )
    )
    return parsed.select(*keys, "pos", "speaker_no", "text", error.alias("error"))


def segment_labels(contents_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Name of each stretch between inline items: its first line's start, else the closing item."""
    is_audio = F.col("kind") == "audio"
    segmented = running(
        contents_,
        keys,
        ["content_idx"],
        [Running("segment", "sum", F.when(is_audio, 1).otherwise(0).cast("bigint"))],
    )
    first_line = F.min_by(
        F.left(F.col("spoken_text"), F.lit(30)), F.when(~is_audio, F.col("content_idx"))
    )
    named = segmented.groupBy(*keys, "segment").agg(
        F.coalesce(first_line, F.max(F.when(is_audio, F.col("label")))).alias("name"),
        F.max(F.when(is_audio, F.lit(1)).otherwise(F.lit(0))).alias("closed"),
    )
    # A script that ends on an inline item still has an empty last stretch.
    ends = named.groupBy(*keys).agg(F.max("segment").alias("segment"), F.max_by("closed", "segment").alias("closed"))
    tails = ends.where("closed = 1").select(
        *keys, (F.col("segment") + 1).alias("segment"), F.lit("script end").alias("name")
    )
    return named.select(*keys, "segment", "name").unionByName(tails)


def transcript(contents_: DataFrame, keys: Sequence[str], block_lines: int = BLOCK_LINES) -> DataFrame:
    """Spoken text of each script joined by newlines, in blocks of bounded size."""
    spoken = contents_.where(F.col("kind") == "line")
    numbered = running(spoken, keys, ["content_idx"], [Running("line_no", "sum", F.lit(1).cast("bigint"))])
    return numbered.groupBy(*keys, chunk_of("line_no", block_lines).alias("block_no")).agg(
        F.expr("listagg(spoken_text, '\n') WITHIN GROUP (ORDER BY line_no)").alias("transcript")
    )


def segment_text(segments: Column) -> Column:
    """One transcript string of an array of segments: stripped texts joined by a space."""
    texts = F.transform(segments, lambda s: T.strip(F.coalesce(s["text"], F.lit(""))))
    return F.array_join(F.filter(texts, lambda s: s != ""), " ")


def batch_voices(requests: DataFrame, batch: str = "batch_no", voices: str = "voice_samples") -> DataFrame:
    """Distinct voices each batch needs."""
    return requests.select(batch, F.explode(voices).alias("voice")).distinct()


def regroup_clips(line_clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offset of every line's clip inside its script's clip.

    Input: keys, ``line_no``, ``frames``. The script clip is as long as the sum.
    """
    return running(
        line_clips,
        keys,
        ["line_no"],
        [Running("offset", "sum", F.col("frames")), Running("script_frames", "total", F.col("frames"))],
    )
