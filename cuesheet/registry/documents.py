"""Documents built from conversations (one per turn) and speaker maps built from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as T
from cuesheet.functions.timing import clean_zero
from cuesheet.operators import validation as V
from cuesheet.registry.common import LB, spread, sql_strip, table
from cuesheet.session import stored
from cuesheet.sources import asr, documents as S

MAP = "<speaker-map>{user: a.wav, assistant: b.wav}</speaker-map>"
# What is wrong with a document, by kind: attributes of its script and what stands before its text.
ATTRS = {
    0: ' pre_gap="0.25" post_gap="-1_0.5" preset="narrator1" tts="QWEN"',
    7: ' post_gap="later"',
    8: ' length="1.0" post_gap="0.5"',
    9: ' length="-1.0"',
    10: ' pre_margin="0.5"',
    11: ' preset="missing-preset"',
    12: ' preset="  "',
    13: ' tts="other"',
}
INLINE = {0: '<mark id="intro"/>', 1: "<sound/>", 2: '<sound ref="door">window</sound>', 3: "<scene/>"}
KINDS = 24


def production_documents(spark, sf_dir):
    turn = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") * 7 + F.col("turn")) % KINDS
    pick = lambda mapping: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k, v)]), kind.cast("int")), F.lit("")
    )
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    root = F.when(kind == 15, F.lit("play")).otherwise(F.lit("production"))
    xml = F.concat(
        F.lit("<"), root, F.lit(">"),
        F.when(kind == 5, F.lit("")).when(kind == 6, F.lit(MAP + MAP)).otherwise(F.lit(MAP)),
        F.when(kind == 14, F.lit("loose text")).otherwise(F.lit("")),
        F.lit("<script"), pick(ATTRS), F.lit(">"), pick(INLINE),
        F.col("role"), F.lit(": "), escaped,
        F.when(kind == 4, F.lit("")).otherwise(F.lit("</script>")),
        F.lit("</"), root, F.lit(">"),
    )
    return turn.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit(".xml")).alias("source"),
        xml.alias("xml"),
    )


def _nodes(spark, sf_dir):
    return S.shred(production_documents(spark, sf_dir))


def shred_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).where("kind <> 'error'").select(
        "doc_id", "node_id", "parent_id", "ordinal", "depth", "kind", "tag", "text"
    )


def doc_errors(spark, sf_dir):
    return V.errors(_nodes(spark, sf_dir)).select("doc_id", "rule", "formatted")


def first_errors(spark, sf_dir):
    return V.first_errors(V.errors(_nodes(spark, sf_dir)))


def plan_timing(spark, sf_dir):
    return V.plan_nodes(_nodes(spark, sf_dir)).select(
        "doc_id", "node_id", "depth", "tag", "value", "pre_gap", "post_gap", "length", "preset", "tts"
    )


def child_counts(spark, sf_dir):
    nodes = stored(_nodes(spark, sf_dir), "nodes")
    one = V.child_count_errors(nodes, "production", "speaker-map", True)
    some = V.child_count_errors(nodes, "script", "mark", False)
    return one.unionByName(some).select("doc_id", "node_id", "n", "message")


def _entries(spark, sf_dir):
    """Speaker maps of customers, one each; most kinds break one rule."""
    kind = (F.col("c_custkey") % 8).cast("int")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    text = (
        F.when(kind == 0, F.concat(name, F.lit(": a.wav\n"), segment, F.lit(": b.wav")))
        .when(kind == 1, name)
        .when(kind == 2, F.lit("{}"))
        .when(kind == 3, F.concat(F.lit("a: 1\n"), name, F.lit(": b.wav")))
        .when(kind == 4, F.lit('"  ": a.wav'))
        .when(kind == 5, F.concat(segment, F.lit(": a.wav\n"), F.lower(segment), F.lit(": b.wav")))
        .when(kind == 6, F.lit(""))
        .otherwise(F.concat(F.lit("- "), name))
    )
    maps = spread(table(spark, sf_dir, "customer")).select(
        F.col("c_custkey").alias("doc_id"),
        F.lit(1).alias("node_id"),
        F.lit("element").alias("kind"),
        F.lit("speaker-map").alias("tag"),
        text.alias("text"),
    )
    return S.speaker_entries(maps)


def speaker_map_entries(spark, sf_dir):
    return S.speakers(_entries(spark, sf_dir))


def speaker_map_rules(spark, sf_dir):
    return S.speaker_errors(_entries(spark, sf_dir))


def asr_segments(spark, sf_dir):
    """Recogniser JSON made from documents: a segment per line, with some times and words missing."""
    lines = table(spark, sf_dir, "documents").select("doc_id", T.stripped_lines(F.col("text")).alias("lines"))
    segments = F.transform(
        "lines",
        lambda line, i: F.struct(
            F.concat(F.lit(" "), line).alias("text"),
            F.when(i % 3 != 1, i.cast("double")).alias("start"),
            (i + 1).cast("double").alias("end"),
            F.when(
                i % 4 != 2,
                F.transform(
                    T.raw_tokens(line),
                    lambda t, k: F.struct(
                        t.alias("word"), F.when(k != 1, i + k / F.lit(10.0)).alias("start"), (i + (k + 1) / F.lit(10.0)).alias("end")
                    ),
                ),
            ).alias("words"),
        ),
    )
    json = lines.select("doc_id", F.to_json(F.struct(F.lit("en").alias("language"), segments.alias("segments"))).alias("json"))
    return json.select("doc_id", asr.parse(F.col("json")).alias("segments"))


def asr_clauses(spark, sf_dir):
    rows = asr_segments(spark, sf_dir).select("doc_id", F.posexplode(asr.clauses(F.col("segments"))).alias("idx", "c"))
    return rows.select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), T.strip(F.col("c.text")).alias("text"),
        F.col("c.start").alias("start_s"), F.col("c.end").alias("end_s"),
    )


def asr_words(spark, sf_dir):
    rows = asr_segments(spark, sf_dir).select("doc_id", F.posexplode(asr.words(F.col("segments"))).alias("idx", "w"))
    return rows.select(
        "doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("w.text").alias("text"),
        clean_zero(F.col("w.start"), 4).alias("start_s"), clean_zero(F.col("w.end"), 4).alias("end_s"),
    )


QUERIES = {
    "shred_nodes": shred_nodes,
    "doc_errors": doc_errors,
    "first_errors": first_errors,
    "plan_timing": plan_timing,
    "child_counts": child_counts,
    "speaker_map_entries": speaker_map_entries,
    "speaker_map_rules": speaker_map_rules,
    "asr_clauses": asr_clauses,
    "asr_words": asr_words,
}


def _case(mapping):
    whens = " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in mapping.items())
    return f"CASE kind {whens} ELSE '' END"


_DOCS = f"""
d AS (SELECT *, conv_id * 1000 + turn AS doc_id, (conv_id * 7 + turn) % {KINDS} AS kind FROM conversations),
x AS (
  SELECT doc_id, kind, 'conv-' || conv_id || '.xml' AS source, role || ': ' || text AS body,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS esc, role,
         CASE WHEN kind = 15 THEN '<play>' ELSE '<production>' END AS root,
         CASE kind WHEN 5 THEN '' WHEN 6 THEN '{MAP}{MAP}' ELSE '{MAP}' END AS maps,
         CASE kind WHEN 14 THEN 'loose text' ELSE '' END AS loose,
         '<script' || {_case(ATTRS)} || '>' AS open, {_case(INLINE)} AS inl,
         CASE kind WHEN 5 THEN 0 WHEN 6 THEN 2 ELSE 1 END AS n_maps FROM d),
c AS (
  SELECT *, length(root) + 1 AS c_map, length(root || maps) + 1 AS c_loose, length(root || maps || loose) + 1 AS c_script,
         length(root || maps || loose || open) + 1 AS c_inline, length(root || maps || loose || open || inl) + 1 AS c_text,
         1 + 2 * n_maps + length(loose) // 10 AS script_id,
         root || maps || loose || open || inl || role || ': ' || esc AS before_end FROM x)"""
_ERRORS = f"""{_DOCS},
e AS (
  SELECT doc_id, source, kind, 0 AS phase, 0 AS node_id, 'root' AS rule, 1 AS line, 1 AS col,
         'The document root must be <production>' AS msg FROM c WHERE kind = 15
  UNION ALL SELECT doc_id, source, kind, 0, script_id + 1, 'child', 1, c_inline, '<script> does not allow child element <scene> <script>' FROM c WHERE kind = 3
  UNION ALL SELECT doc_id, source, kind, 0, 3, 'text', 1, c_loose, '<production> does not allow text content <production>' FROM c WHERE kind = 14
  UNION ALL SELECT doc_id, source, kind, 0, 99, 'parse', length(before_end) - length(replace(before_end, chr(10), '')) + 1,
         length(string_split(before_end, chr(10))[-1]) + 3, 'mismatched tag' FROM c WHERE kind = 4
  UNION ALL SELECT doc_id, source, kind, 1, script_id + 1, 'value', 1, c_inline, '<sound> requires either a ref attribute or text content <sound>' FROM c WHERE kind = 1
  UNION ALL SELECT doc_id, source, kind, 1, script_id + 1, 'value', 1, c_inline, '<sound> text content must match the ref attribute when both are present <sound>' FROM c WHERE kind = 2
  UNION ALL SELECT doc_id, source, kind, 2, 3, 'one map', 1, c_map + {len(MAP)}, 'A <production> may contain only one <speaker-map> <speaker-map>' FROM c WHERE kind = 6
  UNION ALL SELECT doc_id, source, kind, 2, script_id, 'map first', 1, c_script, 'A <script> requires a <speaker-map> to be planned before it <script>' FROM c WHERE kind = 5
  UNION ALL SELECT doc_id, source, kind, 2, script_id, 'post_gap', 1, c_script, '<script> post_gap must be a number of seconds <script>' FROM c WHERE kind = 7
  UNION ALL SELECT doc_id, source, kind, 2, script_id, 'length and gap', 1, c_script, '<script> may not specify both length and post_gap <script>' FROM c WHERE kind = 8
  UNION ALL SELECT doc_id, source, kind, 2, script_id, 'length', 1, c_script, '<script> length must be non-negative seconds <script>' FROM c WHERE kind = 9
  UNION ALL SELECT doc_id, source, kind, 2, script_id, 'margin', 1, c_script, '<script> pre_margin cannot be set on document nodes <script>' FROM c WHERE kind = 10
  UNION ALL SELECT doc_id, source, kind, 3, script_id, 'preset', 1, c_script,
         'Unknown preset ''missing-preset''. Available presets: indoor1, indoor2, master, narrator, outdoor1, outdoor2, thoughts <script>' FROM c WHERE kind = 11
  UNION ALL SELECT doc_id, source, kind, 2, script_id, 'preset empty', 1, c_script, '<script> preset attribute cannot be empty <script>' FROM c WHERE kind = 12
  UNION ALL SELECT doc_id, source, kind, 2, script_id, 'tts', 1, c_script, '<script> tts must be either ''vibevoice'' or ''qwen'' <script>' FROM c WHERE kind = 13)"""
_MAPS = """
k AS (SELECT c_custkey AS doc_id, c_custkey % 8 AS kind, c_name, c_mktsegment FROM customer)"""
_ASR = f"""
docs AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, {LB}),
      lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM documents),
ln AS (SELECT doc_id, generate_subscripts(l, 1)::BIGINT - 1 AS i, unnest(l) AS line FROM docs)"""

ORACLE = {
    "shred_nodes": f"""WITH {_DOCS},
n AS (
  SELECT doc_id, 0 AS node_id, NULL::INTEGER AS parent_id, 0 AS ordinal, 0 AS depth, 'element' AS kind,
         CASE WHEN kind = 15 THEN 'play' ELSE 'production' END AS tag, '' AS text FROM c
  UNION ALL SELECT doc_id, 1 + 2 * m, 0, m, 1, 'element', 'speaker-map', '{{user: a.wav, assistant: b.wav}}' FROM c, (VALUES (0), (1)) AS v(m) WHERE m < n_maps
  UNION ALL SELECT doc_id, 2 + 2 * m, 1 + 2 * m, 0, 2, 'text', NULL, '{{user: a.wav, assistant: b.wav}}' FROM c, (VALUES (0), (1)) AS v(m) WHERE m < n_maps
  UNION ALL SELECT doc_id, 3, 0, 1, 1, 'text', NULL, 'loose text' FROM c WHERE kind = 14
  UNION ALL SELECT doc_id, script_id, 0, n_maps + length(loose) // 10, 1, 'element', 'script', '' FROM c
  UNION ALL SELECT doc_id, script_id + 1, script_id, 0, 2, 'element', CASE kind WHEN 0 THEN 'mark' WHEN 3 THEN 'scene' ELSE 'sound' END,
         CASE kind WHEN 2 THEN 'window' ELSE '' END FROM c WHERE kind < 4
  UNION ALL SELECT doc_id, script_id + 2, script_id + 1, 0, 3, 'text', NULL, 'window' FROM c WHERE kind = 2
  UNION ALL SELECT doc_id, script_id + CASE WHEN kind = 2 THEN 3 WHEN kind < 4 THEN 2 ELSE 1 END, script_id,
         CASE WHEN kind < 4 THEN 1 ELSE 0 END, 2, 'text', NULL, body FROM c)
SELECT doc_id, node_id::INTEGER AS node_id, parent_id::INTEGER AS parent_id, ordinal::INTEGER AS ordinal, depth, kind, tag, text FROM n""",
    "doc_errors": f"WITH {_ERRORS} SELECT doc_id, rule, source || ':' || line || ':' || col || ': ' || msg AS formatted FROM e",
    "first_errors": f"""WITH {_ERRORS}
SELECT doc_id, arg_min(rule, phase * 1000 + node_id) AS rule,
       arg_min(source || ':' || line || ':' || col || ': ' || msg, phase * 1000 + node_id) AS formatted FROM e GROUP BY doc_id""",
    "plan_timing": f"""WITH {_DOCS},
n AS (
  SELECT doc_id, 0 AS node_id, 0 AS depth, 'production' AS tag, NULL AS value, 0.0::DOUBLE AS pre_gap, 0.0::DOUBLE AS post_gap,
         NULL::DOUBLE AS length, NULL AS preset, NULL AS tts FROM c WHERE kind <> 15
  UNION ALL SELECT doc_id, script_id, 1, 'script', NULL, CASE kind WHEN 0 THEN 0.25 ELSE 0 END,
         CASE kind WHEN 0 THEN -10.5 WHEN 8 THEN 0.5 ELSE 0 END, CASE kind WHEN 8 THEN 1.0 WHEN 9 THEN -1.0 END,
         CASE kind WHEN 0 THEN 'narrator1' WHEN 11 THEN 'missing-preset' END,
         CASE kind WHEN 0 THEN 'qwen' WHEN 13 THEN 'other' ELSE 'vibevoice' END FROM c
  UNION ALL SELECT doc_id, script_id + 1, 2, CASE kind WHEN 0 THEN 'mark' ELSE 'sound' END,
         CASE kind WHEN 0 THEN 'intro' WHEN 2 THEN 'door' END, 0, 0, NULL, NULL, NULL FROM c WHERE kind < 3)
SELECT doc_id, node_id::INTEGER AS node_id, depth, tag, value, pre_gap, post_gap, length, preset, tts FROM n""",
    "child_counts": f"""WITH {_DOCS}
SELECT doc_id, 0 AS node_id, n_maps::BIGINT AS n, CASE n_maps WHEN 0 THEN '<production> requires one <speaker-map> element'
       ELSE '<production> may contain only one <speaker-map> element' END AS message FROM c WHERE kind <> 15 AND n_maps <> 1
UNION ALL SELECT doc_id, script_id::INTEGER, 0, '<script> requires at least one <mark> element' FROM c WHERE kind <> 0""",
    "speaker_map_entries": f"""WITH {_MAPS}
SELECT doc_id, 1 AS node_id, lower(c_name) AS speaker_key, c_name AS authored_name, CASE kind WHEN 0 THEN 'a.wav' ELSE 'b.wav' END AS voice_name
FROM k WHERE kind IN (0, 3)
UNION ALL SELECT doc_id, 1, lower(c_mktsegment), c_mktsegment, CASE kind WHEN 0 THEN 'b.wav' ELSE 'a.wav' END FROM k WHERE kind IN (0, 5)""",
    "speaker_map_rules": f"""WITH {_MAPS}
SELECT doc_id, 1 AS node_id, CASE kind WHEN 5 THEN 'speaker twice' ELSE 'speaker-map entry' END AS rule,
       CASE kind WHEN 2 THEN 'The <speaker-map> did not define any speakers'
            WHEN 3 THEN 'Speaker names and voice names in <speaker-map> must be strings'
            WHEN 4 THEN 'Speaker names and voice names in <speaker-map> cannot be empty'
            WHEN 5 THEN 'Speaker ''' || lower(c_mktsegment) || ''' is defined more than once in <speaker-map>'
            ELSE 'The <speaker-map> YAML must be a mapping of speaker names to voice names' END AS message
FROM k WHERE kind <> 0""",
    "asr_clauses": f"""WITH {_ASR}
SELECT doc_id, i AS idx, line AS text, CASE WHEN i % 3 <> 1 THEN i::DOUBLE END AS start_s, (i + 1)::DOUBLE AS end_s FROM ln""",
    "asr_words": f"""WITH {_ASR},
t AS (SELECT doc_id, i, regexp_extract_all(line, '[A-Za-z0-9'']+') AS tk FROM ln WHERE i % 4 <> 2),
w AS (SELECT doc_id, i, generate_subscripts(tk, 1) - 1 AS k, unnest(tk) AS text FROM t),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS idx, text,
       CASE WHEN k <> 1 THEN i + k / 10.0::DOUBLE END AS s, i + (k + 1) / 10.0::DOUBLE AS e FROM w)
SELECT doc_id, idx, text, CASE WHEN round(s, 4) = 0 THEN 0.0 ELSE round(s, 4) END AS start_s, round(e, 4) AS end_s FROM r""",
}
