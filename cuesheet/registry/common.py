"""Shared inputs of the registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuesheet.functions.text import WHITESPACE

RATE = 24_000
KNOWN = ("user", "assistant")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is heavy per row: a small file with few splits is spread over the cores."""
    return spread(table(spark, sf_dir, "documents"))


def spread(found: DataFrame) -> DataFrame:
    """Rows of a table over at least as many tasks as there are cores."""
    cores = found.sparkSession.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


# SQL snippets
LB = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"
WS = f"'{WHITESPACE}'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {WS})"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z0-9'']+')"


def sql_ntok(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z0-9'']+'))::BIGINT"


def sql_round(x: str, digits: int) -> str:
    return f"CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END"


def script_parts(conversations: DataFrame, inline: bool) -> DataFrame:
    """A conversation as a script: each turn a text run, or an inline item if ``inline`` says so."""
    is_audio = (F.col("role") == "system") | (F.col("turn") % 3 == 2) if inline else F.lit(False)
    return conversations.select(
        "conv_id",
        F.col("turn").alias("ordinal"),
        F.when(is_audio, F.lit("audio")).otherwise(F.lit("text")).alias("kind"),
        F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("text"),
        F.when(is_audio, F.concat(F.lit("cue "), F.col("turn").cast("string"))).alias("label"),
        F.array(*[F.lit(k) for k in KNOWN]).alias("speakers"),
    )


def sql_items(inline: bool) -> str:
    """CTEs up to ``items(conv_id, item, audio, speaker_key, label, n_lines, spoken_text, n_continued)``."""
    audio = "(role = 'system' OR turn % 3 = 2)" if inline else "false"
    return f"""
parts AS (
  SELECT conv_id, turn, {audio} AS audio, role || ': ' || text AS txt, 'cue ' || turn AS label
  FROM conversations),
raw AS (
  SELECT conv_id, turn, audio, label, unnest(regexp_split_to_array(txt, {LB})) AS r,
         generate_subscripts(regexp_split_to_array(txt, {LB}), 1) - 1 AS line_no
  FROM parts WHERE NOT audio
  UNION ALL SELECT conv_id, turn, audio, label, '', 0 FROM parts WHERE audio),
stripped AS (SELECT *, {sql_strip('r')} AS line FROM raw),
named AS (
  SELECT *, CASE WHEN strpos(line, ':') > 1
                 THEN {sql_strip("split_part(line, ':', 1)")} END AS nm
  FROM stripped WHERE audio OR line <> ''),
lines AS (
  SELECT conv_id, turn, line_no, audio, CASE WHEN audio THEN label END AS label,
         CASE WHEN NOT audio AND lower(nm) IN ('user', 'assistant') THEN lower(nm) END AS speaker_key,
         CASE WHEN NOT audio AND lower(nm) IN ('user', 'assistant')
              THEN {sql_strip("substr(line, strpos(line, ':') + 1)")} ELSE line END AS piece
  FROM named),
numbered AS (
  SELECT *, sum(CASE WHEN audio OR speaker_key IS NOT NULL THEN 1 ELSE 0 END)
            OVER (PARTITION BY conv_id ORDER BY turn, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS item
  FROM lines),
items AS (
  SELECT conv_id, item, max(CASE WHEN audio THEN 1 ELSE 0 END) AS audio, max(speaker_key) AS speaker_key,
         max(label) AS label, count(*) FILTER (NOT audio AND piece <> '') AS n_lines,
         string_agg(piece, ' ' ORDER BY turn, line_no) FILTER (NOT audio AND piece <> '') AS spoken_text,
         count(*) FILTER (NOT audio AND speaker_key IS NULL) AS n_continued
  FROM numbered GROUP BY conv_id, item)"""


def sql_contents(inline: bool) -> str:
    return f"""{sql_items(inline)},
contents AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY item) - 1 AS content_idx,
         CASE WHEN audio = 1 THEN 'audio' ELSE 'line' END AS kind,
         CASE WHEN audio = 0 THEN speaker_key END AS speaker_key,
         CASE WHEN audio = 0 THEN spoken_text END AS spoken_text,
         CASE WHEN audio = 1 THEN label END AS label
  FROM items WHERE audio = 1 OR (speaker_key IS NOT NULL AND n_lines > 0))"""
