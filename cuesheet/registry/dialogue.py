"""Dialogue parsing over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as T
from cuesheet.operators import dialogue as D
from cuesheet.registry.common import (
    script_parts,
    sql_contents,
    sql_items,
    sql_ntok,
    sql_strip,
    table,
    LB,
)
from cuesheet.session import stored

KEYS = ["conv_id"]


def _items(spark, sf_dir, inline):
    parts = script_parts(table(spark, sf_dir, "conversations"), inline)
    return D.items(D.dialogue_lines(parts, KEYS), KEYS)


def _contents(spark, sf_dir, inline=True):
    """Contents as a stored table: each later stage scans it more than once."""
    return stored(D.contents(_items(spark, sf_dir, inline), KEYS), "contents")


def stanza_turns(spark, sf_dir):
    return D.turns(_items(spark, sf_dir, False)).select(
        "conv_id", "item", "speaker_key", "n_lines", "spoken_text"
    )


def stray_text(spark, sf_dir):
    return D.stray_text(_items(spark, sf_dir, False)).select(
        "conv_id",
        "item",
        "n_continued",
        F.lit("Scripts may begin only with a recognized `speaker:` stanza").alias("message"),
    )


def contents_order(spark, sf_dir):
    return D.contents(_items(spark, sf_dir, True), KEYS)


def speaker_numbers(spark, sf_dir):
    return D.speakers(_contents(spark, sf_dir), KEYS)


def normalized_script(spark, sf_dir):
    return D.normalized_lines(_contents(spark, sf_dir), KEYS)


def normalized_blocks(spark, sf_dir):
    return D.script_blocks(D.normalized_lines(_contents(spark, sf_dir), KEYS), KEYS, 4)


def script_roundtrip(spark, sf_dir):
    blocks = D.script_blocks(D.normalized_lines(_contents(spark, sf_dir), KEYS), KEYS, 4)
    # One voice only: lines of the second speaker are out of range.
    scripts = blocks.withColumn("n_voices", F.lit(1))
    return D.parse_normalized(scripts, ["conv_id", "block_no"])


def segment_labels(spark, sf_dir):
    return D.segment_labels(_contents(spark, sf_dir), KEYS)


def transcript_blocks(spark, sf_dir):
    return D.transcript(_contents(spark, sf_dir), KEYS, 3)


def token_counts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = T.tokens(F.col("text"))
    return documents.select("doc_id", found.alias("t")).select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.try_element_at("t", F.lit(1)).alias("first_token"),
        F.try_element_at("t", F.lit(-1)).alias("last_token"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
    )


def transcript_lines(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id", F.posexplode(T.stripped_lines(F.col("text"))).alias("line_no", "line")
    ).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def text_labels(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id",
        T.transcript_label(F.col("text")).alias("label"),
        T.file_label(T.transcript_label(F.col("text")), "alignment").alias("file_label"),
        T.preview(F.col("text")).alias("preview"),
    )


def segment_transcript(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    segments = F.transform(F.split("text", "\\."), lambda s: F.struct(s.alias("text")))
    return documents.select("doc_id", D.segment_text(segments).alias("transcript"))


def batch_voices(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 10).cast("bigint").alias("batch_no"),
        F.array(
            F.concat(F.lit("voices/"), "role", F.lit(".wav")),
            F.concat(F.lit("voices/guest"), (F.col("turn") % 3).cast("string"), F.lit(".wav")),
        ).alias("voice_samples"),
    )
    return D.batch_voices(requests)


def line_clips(spark, sf_dir):
    lines = D.normalized_lines(_contents(spark, sf_dir), KEYS)
    clips = lines.select("conv_id", "line_no", (T.token_count(F.col("line")) * 100).alias("frames"))
    return D.regroup_clips(clips, KEYS)


QUERIES = {
    "stanza_turns": stanza_turns,
    "stray_text": stray_text,
    "contents_order": contents_order,
    "speaker_numbers": speaker_numbers,
    "normalized_script": normalized_script,
    "normalized_blocks": normalized_blocks,
    "script_roundtrip": script_roundtrip,
    "segment_labels": segment_labels,
    "transcript_blocks": transcript_blocks,
    "token_counts": token_counts,
    "transcript_lines": transcript_lines,
    "text_labels": text_labels,
    "segment_transcript": segment_transcript,
    "batch_voices": batch_voices,
    "line_clips": line_clips,
}

_SPEAKERS = """
speakers AS (
  SELECT conv_id, speaker_key,
         row_number() OVER (PARTITION BY conv_id ORDER BY min(content_idx)) AS speaker_no
  FROM contents WHERE kind = 'line' GROUP BY conv_id, speaker_key)"""
_NORMALIZED = f"""{_SPEAKERS},
nlines AS (
  SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY content_idx) - 1 AS line_no,
         speaker_no, c.speaker_key,
         replace('Speaker ' || speaker_no || ': ' || spoken_text, '’', '''') AS line
  FROM contents c JOIN speakers s USING (conv_id, speaker_key) WHERE kind = 'line')"""
_BLOCKS = f"""{_NORMALIZED},
blocks AS (
  SELECT conv_id, line_no // 4 AS block_no, string_agg(line, chr(10) ORDER BY line_no) AS normalized_script,
         count(*) AS n_lines
  FROM nlines GROUP BY conv_id, line_no // 4)"""
_RE = "'(?s)^Speaker\\s+([0-9]+)\\s*:\\s*(.+)$'"
_SPACES = "'[' || " + sql_strip("''").split(", ", 1)[1][:-1] + " || ']+'"

ORACLE = {
    "stanza_turns": f"""WITH {sql_items(False)}
SELECT conv_id, item, speaker_key, n_lines, spoken_text FROM items
WHERE speaker_key IS NOT NULL AND n_lines > 0""",
    "stray_text": f"""WITH {sql_items(False)}
SELECT conv_id, item, n_continued, 'Scripts may begin only with a recognized `speaker:` stanza' AS message
FROM items WHERE speaker_key IS NULL AND n_continued > 0""",
    "contents_order": f"WITH {sql_contents(True)} SELECT * FROM contents",
    "speaker_numbers": f"WITH {sql_contents(True)}, {_SPEAKERS} SELECT * FROM speakers",
    "normalized_script": f"WITH {sql_contents(True)}, {_NORMALIZED} SELECT * FROM nlines",
    "normalized_blocks": f"WITH {sql_contents(True)}, {_BLOCKS} SELECT * FROM blocks",
    "script_roundtrip": f"""WITH {sql_contents(True)}, {_BLOCKS},
ex AS (
  SELECT conv_id, block_no, unnest(regexp_split_to_array(normalized_script, {LB})) AS r,
         generate_subscripts(regexp_split_to_array(normalized_script, {LB}), 1) - 1 AS pos FROM blocks),
st AS (SELECT conv_id, block_no, pos, {sql_strip('r')} AS line FROM ex),
p AS (
  SELECT *, try_cast(nullif(regexp_extract(line, {_RE}, 1), '') AS BIGINT) AS speaker_no,
         nullif({sql_strip(f"regexp_extract(line, {_RE}, 2)")}, '') AS text
  FROM st WHERE line <> '')
SELECT conv_id, block_no, pos, speaker_no, text,
       CASE WHEN speaker_no IS NULL THEN 'Unsupported normalized script line: ' || line
            WHEN speaker_no < 1 OR speaker_no > 1
            THEN 'Speaker index ' || speaker_no || ' is outside the available voice sample range' END AS error
FROM p""",
    "segment_labels": f"""WITH {sql_contents(True)},
seg AS (
  SELECT *, coalesce(sum(CASE WHEN kind = 'audio' THEN 1 ELSE 0 END) OVER (
      PARTITION BY conv_id ORDER BY content_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment
  FROM contents),
n AS (
  SELECT conv_id, segment,
         coalesce(arg_min(left(spoken_text, 30), content_idx) FILTER (kind = 'line'),
                  max(label) FILTER (kind = 'audio')) AS name,
         max(CASE WHEN kind = 'audio' THEN 1 ELSE 0 END) AS closed
  FROM seg GROUP BY conv_id, segment)
SELECT conv_id, segment, name FROM n
UNION ALL
SELECT conv_id, max(segment) + 1, 'script end' FROM n GROUP BY conv_id HAVING arg_max(closed, segment) = 1""",
    "transcript_blocks": f"""WITH {sql_contents(True)},
l AS (
  SELECT conv_id, spoken_text, row_number() OVER (PARTITION BY conv_id ORDER BY content_idx) - 1 AS line_no
  FROM contents WHERE kind = 'line')
SELECT conv_id, line_no // 3 AS block_no, string_agg(spoken_text, chr(10) ORDER BY line_no) AS transcript
FROM l GROUP BY conv_id, line_no // 3""",
    "token_counts": """
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9'']+'), lambda x: lower(x)) AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_tokens, t[1] AS first_token, t[-1] AS last_token,
       len(list_distinct(t))::BIGINT AS n_distinct FROM t""",
    "transcript_lines": f"""
WITH a AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, {LB}), lambda x: {sql_strip('x')}),
                             lambda x: x <> '') AS l FROM documents)
SELECT doc_id, generate_subscripts(l, 1)::BIGINT - 1 AS line_no, unnest(l) AS line FROM a""",
    "text_labels": f"""
WITH a AS (
  SELECT doc_id, text, coalesce(nullif(left(list_filter(list_transform(regexp_split_to_array(text, {LB}),
      lambda x: {sql_strip('x')}), lambda x: x <> '')[1], 40), ''), 'empty-script') AS label,
      {sql_strip(f"regexp_replace(text, {_SPACES}, ' ', 'g')")} AS plain
  FROM documents)
SELECT doc_id, label,
       coalesce(nullif(lower(trim(regexp_replace(label, '[^A-Za-z0-9]+', '_', 'g'), '_')), ''), 'alignment') AS file_label,
       CASE WHEN length(plain) <= 60 THEN '''' || plain || ''''
            ELSE '''' || left(plain, 30) || ''' ... ''' || right(plain, 30) || '''' END AS preview
FROM a""",
    "segment_transcript": f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'),
    lambda x: {sql_strip('x')}), lambda x: x <> ''), ' ') AS transcript
FROM documents""",
    "batch_voices": """
SELECT DISTINCT conv_id // 10 AS batch_no,
       unnest(['voices/' || role || '.wav', 'voices/guest' || (turn % 3) || '.wav']) AS voice
FROM conversations""",
    "line_clips": f"""WITH {sql_contents(True)}, {_NORMALIZED},
f AS (SELECT conv_id, line_no, {sql_ntok('line')} * 100 AS frames FROM nlines)
SELECT conv_id, line_no, frames,
       coalesce(sum(frames) OVER (PARTITION BY conv_id ORDER BY line_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       sum(frames) OVER (PARTITION BY conv_id)::BIGINT AS script_frames
FROM f""",
}
