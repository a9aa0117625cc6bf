"""Keys, caches, batches, presets, settings and debug output."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as T

from cuesheet.operators import alignment as A
from cuesheet.operators import blocks as B
from cuesheet.operators import dialogue as D
from cuesheet.operators import presets as P
from cuesheet.operators import requests as R

from cuesheet.registry.common import LB, RATE, documents, sql_contents, sql_ntok, sql_strip, table
from cuesheet.registry.dialogue import KEYS, _NORMALIZED, _contents

from cuesheet.session import stored, work_path
from cuesheet.sources import caches
from cuesheet.sources import debug as G
from cuesheet import settings as C

AUDIO_GRID = 12


def request_keys(spark, sf_dir):
    lines = D.normalized_lines(_contents(spark, sf_dir), KEYS)
    return R.digest(lines, KEYS, F.col("line_no"), F.col("line"), F.col("speaker_key"))

def align_keys(spark, sf_dir):
    contents = _contents(spark, sf_dir)
    return R.digest(
        contents, KEYS, F.col("content_idx"), F.col("kind"), F.col("speaker_key"), F.col("spoken_text"), F.col("label"),
        F.lit(RATE), F.lit(2),
    )

def audio_keys(spark, sf_dir):
    """Keys over audio: stereo clips in blocks of 8 frames, hashed on a grid of 12."""
    half = lambda rest: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.get("embedding", i * 2 + rest))
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "clip_id")
    blocks = B.cut_blocks(vectors.select("clip_id", half(0).alias("l"), half(1).alias("r")), F.col("l"), F.col("r"), 8)
    contents = vectors.select("clip_id", F.sha2(F.col("label").cast("string"), 256).alias("digest"))
    return R.alignment_keys(contents, R.audio_digests(blocks, AUDIO_GRID), RATE)

def request_cells(spark, sf_dir):
    """Keys of requests that are one row each, equal to the file names of an existing cache."""
    return documents(spark, sf_dir).select(
        "doc_id", R.canonical_key(F.col("text"), F.array(F.concat(F.lit("voices/"), "lang", F.lit(".wav")))).alias("key")
    )

def _keyed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), "n_chars")

def _render_cache(spark, sf_dir):
    """Half of all texts have been rendered before."""
    keyed = _keyed(spark, sf_dir).where(F.col("key") < "8")
    return keyed.groupBy("key").agg(F.max("n_chars").alias("frame_count"), F.lit(24000).alias("sample_rate"))

def cache_split(spark, sf_dir):
    split = R.split_by_cache(_keyed(spark, sf_dir), _render_cache(spark, sf_dir), "live")
    return split.select("doc_id", "key", "state", "frame_count")

def cache_miss(spark, sf_dir):
    return R.cache_misses(_keyed(spark, sf_dir), _render_cache(spark, sf_dir)).select("doc_id", "key")

def _position_cache(spark, sf_dir):
    texts = documents(spark, sf_dir).select("doc_id", T.stripped_lines(F.col("text")).alias("lines"))
    # Stored: scripts are read several times, and an inlined array would be split anew for each position.
    lines = stored(texts, "position_lines")
    kept = F.when(F.col("doc_id") % 9 == 0, F.size("lines") - 1).otherwise(F.size("lines"))
    positions = A.let(
        lambda n: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n), lambda i: i * F.lit(0.25)),
        n=kept,
    )
    cached = lines.where("doc_id % 4 <> 1").select("doc_id", positions.alias("start_positions"))
    contents = A.unfold(lines, ["doc_id"], F.col("lines"), "idx", "line")
    return contents, cached

def cached_positions(spark, sf_dir):
    contents, cached = _position_cache(spark, sf_dir)
    return R.apply_positions(contents, cached, "doc_id").select("doc_id", "idx", "line", "start_pos")

def position_errors(spark, sf_dir):
    contents, cached = _position_cache(spark, sf_dir)
    return R.position_errors(contents, cached, "doc_id")

def _batched(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").where(T.token_count(F.col("text")) > 0)
    return R.batches(requests.select("conv_id", "turn", "role"), "conv_id", ["turn"])

def batch_numbers(spark, sf_dir):
    return _batched(spark, sf_dir)

def line_batches(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(T.stripped_lines(F.col("text"))).alias("line_no", "line")
    )
    numbered = R.batches(lines.drop("line"), "conv_id", ["turn", "line_no"])
    return numbered.withColumn("line_no", F.col("line_no").cast("bigint"))

def first_batch(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").where(T.token_count(F.col("text")) > 0)
    return R.first_batch(requests.select("conv_id", "turn", "role"), "conv_id", ["turn"])

def result_zip(spark, sf_dir):
    requests = _batched(spark, sf_dir)
    results = requests.where((F.col("conv_id") % 17 != 3)).select(
        F.when(F.col("pos") == 9, F.col("batch_no") + 1_000_000).otherwise(F.col("batch_no")).alias("batch_no"),
        "pos",
        F.length("role").cast("bigint").alias("frames"),
    )
    return R.zip_results(requests, results).select("batch_no", "pos", "conv_id", "turn", "frames", "status")

def route(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, "qwen").otherwise("vibevoice").alias("tts")
    )
    return R.route(requests, "qwen")

def replay_frames(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    rate = F.when(F.col("l_linenumber") % 2 == 0, 22_050).otherwise(24_000)
    return lineitem.groupBy("l_quantity", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("l_quantity").cast("bigint").alias("native"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        "n",
        R.replay_frames(F.col("l_quantity").cast("bigint") * 77, rate, F.lit(48_000)).alias("frames"),
    )

def _named(spark, sf_dir):
    spellings = [" Narrator1 ", "narrator2", "INDOOR1", "outdoor2", "thoughts", "hall", "master", "none"]
    pick = F.element_at(F.array(*[F.lit(s) for s in spellings]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("preset_name"))

def preset_lookup(spark, sf_dir):
    chained = P.with_chain(_named(spark, sf_dir), P.catalog(spark), "preset_name")
    return chained.groupBy("doc_id", "preset").agg(
        F.count(F.lit(1)).alias("n_stages"), F.min_by("stage", "stage_no").alias("first_stage")
    )

def preset_errors(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", P.preset_error(F.col("preset_name")).alias("error")).where("error is not null")

def _preview_requests(spark, sf_dir):
    quality = (F.col("doc_id") % 5).cast("int")
    names = F.slice(
        F.array(*[F.lit(n) for n in (" NARRATOR1", "narrator", "none", "indoor2", "cave", "outdoor1", "Outdoor1")]),
        quality + 1,
        F.when(quality == 4, F.lit(0)).otherwise(F.lit(4)),
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("clip_id"), names.alias("names"), "quality")

def _prepared(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality = 1").select(
        F.col("doc_id").alias("clip_id"), F.lit("narrator").alias("preset")
    ).distinct()

def preset_prepare(spark, sf_dir):
    todo = P.preparations(_preview_requests(spark, sf_dir), _prepared(spark, sf_dir))
    return todo.select("clip_id", F.col("idx").cast("bigint").alias("idx"), "preset")

def prepare_errors(spark, sf_dir):
    return P.preparation_errors(_preview_requests(spark, sf_dir))

def slice_status(spark, sf_dir):
    named = _named(spark, sf_dir).withColumnRenamed("doc_id", "clip_id")
    return P.slice_status(named, _prepared(spark, sf_dir)).select("clip_id", "preset", "status")

def settings(spark, sf_dir):
    key = F.col("o_orderkey")
    authored = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 3 == 0, 0).when(key % 3 == 1, 44_100).alias("output_sample_rate"),
        F.when(key % 4 == 0, 1).alias("output_channels"),
        F.when(key % 5 == 0, 0).when(key % 5 == 1, 4).alias("batch_size"),
        F.when(key % 6 == 0, "").when(key % 6 == 1, "cpu").alias("device"),
        F.when(key % 7 == 0, 0.0).when(key % 7 == 1, 2.5).alias("cfg_scale"),
        F.when(key % 8 == 0, True).when(key % 8 == 1, False).alias("disable_prefill"),
        F.when(key % 9 == 0, 0).alias("ddpm_inference_steps"),
        F.split("o_orderpriority", "").alias("debug_categories"),
    )
    resolved = C.resolve(authored)
    return resolved.select(
        "o_orderkey", "output_sample_rate", "output_channels", "batch_size", "device", "cfg_scale", "disable_prefill",
        "ddpm_inference_steps", F.array_join("debug_categories", "").alias("debug_categories"),
    )

def debug_lines(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    category = F.when(F.col("role") == "user", "compose_audio").when(F.col("role") == "system", "nonsense").otherwise("whisperx")
    messages = turns.select(
        "conv_id", "turn", category.alias("category"),
        F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" "), T.preview(F.col("text"))).alias("message"),
    )
    return G.debug_lines(messages, ["compose_audio"]).select("conv_id", "turn", "category", "line")

def debug_artifacts(spark, sf_dir):
    requests = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.col("role"), F.lit(": "), "text").alias("script")
    )
    return G.artifact_names(requests, "conv_id", ["turn"], T.request_label(F.col("script")), "audio", "wav").select(
        "conv_id", "turn", "file_name"
    )

def preview_names(spark, sf_dir):
    """All previews of every clip, of which those of some labels have been made."""
    clips = table(spark, sf_dir, "embeddings").select("vec_id", F.pmod("label", F.lit(2)).alias("made"))
    names = P.preview_names(spark)
    listed = names.agg(F.array_sort(F.collect_list(F.struct("idx", "preset"))).alias("all"))
    # One row of a fixed list, so this is no product of tables.
    asked = clips.join(F.broadcast(listed), F.lit(True)).select("vec_id", "made", F.explode("all").alias("p"))
    return asked.where("made = 0 OR p.preset <> 'none'").select("vec_id", F.col("p.idx").alias("idx"), F.col("p.preset").alias("preset"))


def cache_appends(spark, sf_dir):
    """Renders appended in two overlapping rounds, then again: each key is there once, as it was first."""
    path = work_path(spark, "render-cache")
    rows = _keyed(spark, sf_dir).groupBy("key").agg(F.min("n_chars").cast("bigint").alias("frame_count"))
    first = rows.where("key < 'a'").withColumn("sample_rate", F.lit(24000))
    second = rows.where("key > '4'").withColumn("sample_rate", F.lit(48000))
    for entries in (first, second, first):
        caches.append_cache(entries, path, caches.RENDER_SCHEMA)
    return caches.read_cache(spark, path, caches.RENDER_SCHEMA)


def align_cache(spark, sf_dir):
    """Start positions of scripts written to the cache and put back onto their contents."""
    contents = _contents(spark, sf_dir).select(F.col("conv_id").cast("string").alias("key"), F.col("content_idx").alias("idx"), "kind")
    # The contents of one script, whose positions are one cell of the cache.
    positions = contents.groupBy("key").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    entries = positions.select("key", F.transform("ids", lambda i: i * F.lit(0.5)).alias("start_positions"))
    path = work_path(spark, "align-cache")
    caches.append_cache(entries, path, caches.ALIGN_SCHEMA)
    return R.apply_positions(contents, caches.read_cache(spark, path, caches.ALIGN_SCHEMA))


def without_audio(spark, sf_dir):
    """Scripts that alignment passes by."""
    aligned, unchanged = A.needs_alignment(_contents(spark, sf_dir), KEYS)
    shown = lambda df, flag: df.select("conv_id", "content_idx", "kind", F.lit(flag).alias("aligned"))
    return shown(aligned, True).unionByName(shown(unchanged, False))


def renderer_batches(spark, sf_dir):
    """Requests through a renderer that is loaded once per task and sees them batch by batch."""
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")

    def renderer(frames):
        per_char = 3
        for frame in frames:
            yield frame[["batch_no", "pos", "request_id"]].assign(frames=frame["text"].str.len() * per_char)

    return R.run_renderer(
        R.batches(asked, "request_id", ["request_id"]), renderer, "batch_no bigint, pos bigint, request_id bigint, frames bigint"
    )


QUERIES = {
    "preview_names": preview_names,
    "cache_appends": cache_appends,
    "align_cache": align_cache,
    "without_audio": without_audio,
    "renderer_batches": renderer_batches,
    "request_keys": request_keys,
    "align_keys": align_keys,
    "audio_keys": audio_keys,
    "request_cells": request_cells,
    "cache_split": cache_split,
    "cache_miss": cache_miss,
    "cached_positions": cached_positions,
    "position_errors": position_errors,
    "batch_numbers": batch_numbers,
    "line_batches": line_batches,
    "first_batch": first_batch,
    "result_zip": result_zip,
    "route": route,
    "replay_frames": replay_frames,
    "preset_lookup": preset_lookup,
    "preset_errors": preset_errors,
    "preset_prepare": preset_prepare,
    "prepare_errors": prepare_errors,
    "slice_status": slice_status,
    "settings": settings,
    "debug_lines": debug_lines,
    "debug_artifacts": debug_artifacts,
}

def _sql_digest(source, key, *content):
    text = " || chr(31) || ".join(f"coalesce(({c})::VARCHAR, chr(0))" for c in content)
    lanes = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT)::HUGEINT::VARCHAR AS l{i}" for i in range(R.LANES))
    joined = " || ':' || ".join(f"l{i}" for i in range(R.LANES))
    return f"""
h AS (SELECT {key}, sha256({text}) AS h FROM {source}),
s AS (SELECT {key}, count(*) AS n_rows, {lanes} FROM h GROUP BY {key})
SELECT {key}, n_rows, sha256(n_rows || ':' || {joined}) AS digest FROM s"""

def _sql_audio_keys():
    hashed, _, chosen = _sql_digest("cells", "clip_id", "cell", "sha").rpartition("SELECT ")
    exponent = "floor(log2(abs(x)))"
    return f"""
WITH e AS (
  SELECT vec_id AS clip_id, generate_subscripts(embedding, 1)::BIGINT - 1 AS i, unnest(embedding)::FLOAT::DOUBLE AS x FROM embeddings),
b AS (
  SELECT clip_id, i, CASE WHEN x = 0 THEN 0 ELSE (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END) + ({exponent}::BIGINT + 127) * 8388608
         + ((abs(x) / pow(2.0::DOUBLE, {exponent}) - 1) * 8388608)::BIGINT END AS v FROM e),
cells AS (
  SELECT clip_id, i // 2 // {AUDIO_GRID} AS cell, sha256(unhex(string_agg(lpad(to_hex(v % 256), 2, '0') || lpad(to_hex(v // 256 % 256), 2, '0')
         || lpad(to_hex(v // 65536 % 256), 2, '0') || lpad(to_hex(v // 16777216), 2, '0'), '' ORDER BY i))) AS sha
  FROM b GROUP BY clip_id, i // 2 // {AUDIO_GRID}),
{hashed.strip()},
d AS (SELECT {chosen})
SELECT clip_id, sha256(sha256(label::VARCHAR) || ':' || digest || ':32:2:{RATE}:{R.VERSION}') AS key
FROM d JOIN embeddings ON vec_id = clip_id"""


_KEYED = """
k AS (SELECT doc_id, sha256(text) AS key, n_chars FROM documents),
cache AS (SELECT key, max(n_chars) AS frame_count FROM k WHERE key < '8' GROUP BY key)"""
_POSITIONS = f"""
docs AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, {LB}),
      lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM documents),
ln AS (SELECT doc_id, generate_subscripts(l, 1)::BIGINT - 1 AS idx, unnest(l) AS line FROM docs)"""
_BATCHED = f"""
b AS (
  SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position
  FROM conversations WHERE {sql_ntok('text')} > 0),
q AS (SELECT conv_id, turn, role, position // 10 AS batch_no, position % 10 AS pos FROM b)"""
_NAMED = """
nm AS (SELECT doc_id, [' Narrator1 ', 'narrator2', 'INDOOR1', 'outdoor2', 'thoughts', 'hall', 'master', 'none'][doc_id % 8 + 1] AS preset_name FROM documents),
cn AS (
  SELECT *, CASE lower(trim(preset_name)) WHEN 'narrator1' THEN 'narrator' WHEN 'narrator2' THEN 'thoughts'
      ELSE lower(trim(preset_name)) END AS preset FROM nm)"""
_PREVIEW = """
rq AS (
  SELECT doc_id AS clip_id, quality, CASE WHEN doc_id % 5 = 4 THEN [] ELSE list_slice(
      ['narrator', 'narrator', 'none', 'indoor2', 'cave', 'outdoor1', 'outdoor1'], doc_id % 5 + 1, doc_id % 5 + 4) END AS names FROM labels),
ex AS (SELECT clip_id, generate_subscripts(names, 1) AS i, unnest(names) AS preset FROM rq),
ds AS (SELECT clip_id, preset, min(i) AS i FROM ex GROUP BY clip_id, preset),
rk AS (SELECT clip_id, preset, row_number() OVER (PARTITION BY clip_id ORDER BY i) - 1 AS idx FROM ds),
done AS (SELECT DISTINCT doc_id AS clip_id, 'narrator' AS preset FROM labels WHERE quality = 1)"""

ORACLE = {
    "preview_names": """
WITH p AS (
  SELECT unnest(['none', 'indoor1', 'indoor2', 'narrator', 'outdoor1', 'outdoor2', 'thoughts']) AS preset, unnest(range(7))::INTEGER AS idx)
SELECT vec_id, idx, preset FROM embeddings, p WHERE label % 2 = 0 OR preset <> 'none'""",
    "cache_appends": """
WITH k AS (SELECT sha256(text) AS key, min(n_chars)::BIGINT AS frame_count FROM documents GROUP BY 1)
SELECT key, CASE WHEN key < 'a' THEN 24000 ELSE 48000 END AS sample_rate, frame_count FROM k""",
    "align_cache": f"""WITH {sql_contents(True)}
SELECT conv_id::VARCHAR AS key, content_idx AS idx, kind, content_idx * 0.5::DOUBLE AS start_pos FROM contents""",
    "without_audio": f"""WITH {sql_contents(True)}
SELECT conv_id, content_idx, kind, bool_or(kind = 'audio') OVER (PARTITION BY conv_id) AS aligned FROM contents""",
    "renderer_batches": """
WITH r AS (
  SELECT conv_id * 1000 + turn AS request_id, text, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS n FROM conversations)
SELECT n // 10 AS batch_no, n % 10 AS pos, request_id, length(text) * 3 AS frames FROM r""",
    "request_keys": f"WITH {sql_contents(True)}, {_NORMALIZED}, " + _sql_digest("nlines", "conv_id", "line_no", "line", "speaker_key"),
    "align_keys": f"WITH {sql_contents(True)}, "
    + _sql_digest("contents", "conv_id", "content_idx", "kind", "speaker_key", "spoken_text", "label", str(RATE), "2"),
    "audio_keys": _sql_audio_keys(),
    "cache_split": f"""WITH {_KEYED}
SELECT doc_id, k.key, CASE WHEN c.key IS NULL THEN 'compute' ELSE 'hit' END AS state, frame_count FROM k LEFT JOIN cache c ON c.key = k.key""",
    "cache_miss": f"WITH {_KEYED} SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM cache)",
    "cached_positions": f"""WITH {_POSITIONS}
SELECT doc_id, idx, line, idx * 0.25::DOUBLE AS start_pos FROM ln WHERE doc_id % 4 <> 1 AND doc_id % 9 <> 0""",
    "position_errors": f"""WITH {_POSITIONS}
SELECT doc_id, len(l)::BIGINT AS n_contents, len(l)::BIGINT - 1 AS n_positions,
       'Cached forced-alignment metadata length does not match contents' AS message
FROM docs WHERE doc_id % 4 <> 1 AND doc_id % 9 = 0 AND len(l) > 0""",
    "batch_numbers": f"WITH {_BATCHED} SELECT * FROM q",
    "line_batches": f"""
WITH l AS (
  SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, {LB}), lambda x: {sql_strip('x')}), lambda x: x <> '') AS l
  FROM conversations),
e AS (SELECT conv_id, turn, unnest(range(len(l))) AS line_no FROM l),
p AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, line_no) - 1 AS position FROM e)
SELECT conv_id, turn, line_no, position // 10 AS batch_no, position % 10 AS pos FROM p""",
    "first_batch": f"WITH {_BATCHED} SELECT conv_id, turn, role FROM q WHERE batch_no = 0",
    "result_zip": f"""WITH {_BATCHED},
r AS (
  SELECT CASE WHEN pos = 9 THEN batch_no + 1000000 ELSE batch_no END AS batch_no, pos, length(role)::BIGINT AS frames
  FROM q WHERE conv_id % 17 <> 3)
SELECT coalesce(q.batch_no, r.batch_no) AS batch_no, coalesce(q.pos, r.pos) AS pos, conv_id, turn, frames,
       CASE WHEN r.pos IS NULL THEN 'missing result' WHEN q.pos IS NULL THEN 'result without request' ELSE 'ok' END AS status
FROM q FULL JOIN r ON q.batch_no = r.batch_no AND q.pos = r.pos""",
    "route": "SELECT conv_id, turn, 'qwen' AS tts FROM conversations WHERE conv_id % 3 = 0",
    "replay_frames": """
SELECT l_quantity::BIGINT AS native, l_linenumber::BIGINT AS line, count(*) AS n,
       CASE WHEN l_linenumber % 2 = 0 THEN (l_quantity::BIGINT * 77 * 320 + 146) // 147 ELSE l_quantity::BIGINT * 154 END AS frames
FROM lineitem GROUP BY l_quantity, l_linenumber""",
    "preset_lookup": f"""WITH {_NAMED}
SELECT doc_id, preset, CASE preset WHEN 'master' THEN 1 ELSE 5 END::BIGINT AS n_stages,
       CASE preset WHEN 'master' THEN 'loudness' ELSE 'highpass' END AS first_stage FROM cn WHERE preset NOT IN ('hall', 'none')""",
    "preset_errors": f"""WITH {_NAMED}
SELECT doc_id, 'Unknown preset ''' || preset_name || '''. Available presets: indoor1, indoor2, master, narrator, outdoor1, outdoor2, thoughts' AS error
FROM cn WHERE preset IN ('hall', 'none')""",
    "preset_prepare": f"""WITH {_PREVIEW}
SELECT clip_id, idx, preset FROM rk WHERE preset <> 'cave' AND (clip_id, preset) NOT IN (SELECT (clip_id, preset) FROM done)""",
    "prepare_errors": f"""WITH {_PREVIEW}
SELECT clip_id, CASE WHEN len(names) = 0 THEN 'At least one preset name is required' ELSE 'Unknown preset: cave' END AS error
FROM rq WHERE len(names) = 0 OR list_contains(names, 'cave')""",
    "slice_status": f"""WITH {_NAMED},
done AS (SELECT DISTINCT doc_id AS clip_id, 'narrator' AS preset FROM labels WHERE quality = 1)
SELECT doc_id AS clip_id, cn.preset, CASE WHEN done.clip_id IS NOT NULL OR cn.preset = 'none' THEN 'ok'
       WHEN cn.preset IN ('hall', 'master') THEN 'unknown preset' ELSE 'not prepared' END AS status
FROM cn LEFT JOIN done ON done.clip_id = doc_id AND done.preset = cn.preset""",
    "settings": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 44100 ELSE 48000 END AS output_sample_rate,
       CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS output_channels,
       CASE WHEN o_orderkey % 5 = 1 THEN 4 ELSE 10 END AS batch_size,
       CASE WHEN o_orderkey % 6 = 1 THEN 'cpu' ELSE 'cuda' END AS device,
       CASE WHEN o_orderkey % 7 = 0 THEN 0.0 WHEN o_orderkey % 7 = 1 THEN 2.5 ELSE 1.2 END::DOUBLE AS cfg_scale,
       o_orderkey % 8 = 0 AS disable_prefill, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 8 END AS ddpm_inference_steps,
       (SELECT string_agg(ch, '' ORDER BY i) FROM (SELECT ch, min(i) AS i FROM (
          SELECT unnest(string_split(o_orderpriority, '')) AS ch, generate_subscripts(string_split(o_orderpriority, ''), 1) AS i) GROUP BY ch)) AS debug_categories
FROM orders""",
    "debug_lines": f"""
WITH a AS (
  SELECT conv_id, turn, {sql_strip(f"regexp_replace(text, '[' || {sql_strip('x').split(', ', 1)[1][:-1]} || ']+', ' ', 'g')")} AS plain
  FROM conversations WHERE role = 'user')
SELECT conv_id, turn, 'compose_audio' AS category, '[compose_audio] turn ' || turn || ' ' ||
       CASE WHEN length(plain) <= 60 THEN '''' || plain || ''''
            ELSE '''' || left(plain, 30) || ''' ... ''' || right(plain, 30) || '''' END AS line FROM a""",
    "debug_artifacts": f"""
WITH a AS (
  SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(role || ': ' || text, {LB}),
      lambda x: {sql_strip('x')}), lambda x: x <> '')[1] AS f, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations),
b AS (SELECT *, {sql_strip(f"regexp_replace(substr(f, strpos(f, ':') + 1), '[' || {sql_strip('x').split(', ', 1)[1][:-1]} || ']+', ' ', 'g')")} AS label FROM a)
SELECT conv_id, turn, printf('%03d', n) || '-' || coalesce(nullif(lower(trim(regexp_replace(
    coalesce(nullif(left(label, 40), ''), 'empty-script'), '[^A-Za-z0-9]+', '_', 'g'), '_')), ''), 'audio') || '.wav' AS file_name FROM b""",
}
