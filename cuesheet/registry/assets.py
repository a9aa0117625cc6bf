"""Voice and sound lookup over supplier names and page paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.operators import assets as X
from cuesheet.operators.scans import attach, chunk_of, salt
from cuesheet.registry.common import table

VOICES = "/voices"
SOUNDS = "/sounds"


def _voice_files(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".MP3", ".flac", ".txt")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit(f"{VOICES}/"), "s_name", suffix).alias("path"))


def _voice_refs(spark, sf_dir):
    """Customers ask for a supplier's voice, each in one of eight spellings."""
    key = F.col("c_custkey") % 60
    name = F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".MP3", ".flac", ".txt")]), (key % 4 + 1).cast("int"))
    full = F.concat(name, suffix)
    kind = F.col("c_custkey") % 8
    voice = (
        F.when(kind == 0, F.concat(F.lit(f"{VOICES}/"), full))
        .when(kind == 1, full)
        .when(kind == 2, name)
        .when(kind == 3, F.lower(name))
        .when(kind == 4, F.concat(F.lit("extra/"), full))
        .when(kind == 5, F.lower(full))
        .when(kind == 6, F.concat(F.upper(name), F.lit(".ogg")))
        .otherwise(F.concat(F.lit("nobody"), F.col("c_nationkey").cast("string")))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", voice.alias("voice_name"))


def voice_catalog(spark, sf_dir):
    return X.voice_catalog(_voice_files(spark, sf_dir))


def available_voices(spark, sf_dir):
    return X.available_voices(_voice_files(spark, sf_dir))


def voice_resolve(spark, sf_dir):
    refs = _voice_refs(spark, sf_dir)
    resolved = X.resolve_voices(refs, _voice_files(spark, sf_dir), VOICES)
    return X.voices_of(refs, resolved, chunk_of("c_custkey")).select(
        "c_custkey", "voice_name", "resolved_path", F.col("prio").cast("bigint").alias("prio")
    )


def voice_missing(spark, sf_dir):
    resolved = X.resolve_voices(_voice_refs(spark, sf_dir), _voice_files(spark, sf_dir), VOICES)
    return X.missing_voices(resolved, VOICES)


def _page_path():
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return F.regexp_replace(bare, "/+$", "")


def _sound_files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.concat(_page_path(), F.lit(".wav")).alias("path")).distinct()


def _sound_refs(spark, sf_dir):
    """Pages ask by the last one or two path parts, some with an extension, backslashes or a full path."""
    parts = F.split(_page_path(), "/")
    last, two = F.element_at(parts, -1), F.concat_ws("/", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)))
    kind = F.col("page_id") % 6
    ref = (
        F.when(kind == 0, last)
        .when(kind == 1, two)
        .when(kind == 2, F.concat(two, F.lit(".wav")))
        .when(kind == 3, F.concat(F.replace(two, F.lit("/"), F.lit("\\")), F.lit(".v1")))
        .when(kind == 4, F.concat(F.lit(f"{SOUNDS}/"), _page_path(), F.lit(".wav")))
        .otherwise(F.concat(F.lit("/gone/"), last))
    )
    return table(spark, sf_dir, "pages").select("page_id", ref.alias("ref"))


def sound_resolve(spark, sf_dir):
    return X.resolve_sounds(_sound_refs(spark, sf_dir), _sound_files(spark, sf_dir), SOUNDS)


def sound_ambiguous(spark, sf_dir):
    return X.ambiguous_files(_sound_refs(spark, sf_dir), _sound_files(spark, sf_dir))


def sound_uses(spark, sf_dir):
    """Each resolved file is prepared once, however many pages use it."""
    refs = _sound_refs(spark, sf_dir)
    found = X.resolve_sounds(refs, _sound_files(spark, sf_dir), SOUNDS).where("resolved_path is not null")
    uses = attach(refs, found, ["ref"], salt("page_id")).select("page_id", F.col("resolved_path").alias("path"))
    stage = lambda files: files.withColumn("frames", F.length("path").cast("bigint") * 100)
    return X.normalise_once(uses, stage)


def sounds_root(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    configured = F.when(F.col("page_id") % 3 == 0, F.lit("/library"))
    return pages.select("page_id", X.sounds_root(configured, F.concat(F.lit("/"), _page_path(), F.lit(".xml"))).alias("root"))


QUERIES = {
    "voice_catalog": voice_catalog,
    "available_voices": available_voices,
    "voice_resolve": voice_resolve,
    "voice_missing": voice_missing,
    "sound_resolve": sound_resolve,
    "sound_ambiguous": sound_ambiguous,
    "sound_uses": sound_uses,
    "sounds_root": sounds_root,
}

_EXT = "['.wav', '.mp3', '.flac', '.ogg', '.m4a', '.aac']"


def _name(x):
    return f"string_split({x}, '/')[-1]"


def _stem(x):
    return f"regexp_replace({x}, '^(.+)\\.[^.]+$', '\\1')"


def _extension(x):
    return f"lower(regexp_extract({x}, '^.+(\\.[^.]+)$', 1))"


_VOICES = f"""
files AS (
  SELECT '{VOICES}/' || s_name || ['.wav', '.MP3', '.flac', '.txt'][s_suppkey % 4 + 1] AS path FROM supplier),
ok AS (SELECT path, {_name('path')} AS nm FROM files WHERE {_extension(_name('path'))} IN (SELECT unnest({_EXT}))),
catalog AS (
  SELECT key, min(path) AS path FROM (
    SELECT path, unnest([nm, {_stem('nm')}, lower(nm), lower({_stem('nm')})]) AS key FROM ok) GROUP BY key),
asked AS (
  SELECT c_custkey, 'Supplier#' || lpad((c_custkey % 60)::VARCHAR, 9, '0') AS nm,
         'Supplier#' || lpad((c_custkey % 60)::VARCHAR, 9, '0') || ['.wav', '.MP3', '.flac', '.txt'][c_custkey % 60 % 4 + 1] AS fl,
         c_custkey % 8 AS kind, c_nationkey FROM customer),
refs AS (
  SELECT c_custkey, CASE kind WHEN 0 THEN '{VOICES}/' || fl WHEN 1 THEN fl WHEN 2 THEN nm WHEN 3 THEN lower(nm)
      WHEN 4 THEN 'extra/' || fl WHEN 5 THEN lower(fl) WHEN 6 THEN upper(nm) || '.ogg'
      ELSE 'nobody' || c_nationkey END AS voice_name FROM asked),
wanted AS (SELECT DISTINCT voice_name, {_name('voice_name')} AS nm FROM refs),
cand AS (
  SELECT voice_name, 'path' AS kind, unnest([voice_name, '{VOICES}/' || voice_name]) AS key, unnest([0, 1]) AS prio FROM wanted
  UNION ALL
  SELECT voice_name, 'catalog', unnest([voice_name, nm, {_stem('nm')}, lower(voice_name), lower(nm), lower({_stem('nm')})]),
         unnest([2, 3, 4, 5, 6, 7]) FROM wanted),
look AS (SELECT 'path' AS kind, path AS key, path FROM files UNION ALL SELECT 'catalog', key, path FROM catalog),
res AS (
  SELECT voice_name, arg_min(path, prio) AS resolved_path, min(prio)::BIGINT AS prio
  FROM cand JOIN look USING (kind, key) GROUP BY voice_name)"""

_PAGE = "regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"
_SOUNDS = f"""
pg AS (SELECT page_id, {_PAGE} AS p, string_split({_PAGE}, '/') AS parts FROM pages),
files AS (SELECT DISTINCT p || '.wav' AS path FROM pg),
refs AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN parts[-1] WHEN 1 THEN array_to_string(parts[-2:], '/')
      WHEN 2 THEN array_to_string(parts[-2:], '/') || '.wav'
      WHEN 3 THEN array_to_string(parts[-2:], '\\') || '.v1'
      WHEN 4 THEN '{SOUNDS}/' || p || '.wav' ELSE '/gone/' || parts[-1] END AS ref
  FROM pg),
wanted AS (
  SELECT DISTINCT ref, regexp_replace(replace(ref, '\\', '/'), '([^/])\\.[^./]+$', '\\1') AS bare FROM refs),
cand AS (
  SELECT w.ref, f.path, len(string_split(f.path, '/')) - len(string_split(w.bare, '/')) AS diff
  FROM wanted w JOIN files f ON w.ref NOT LIKE '/%'
   AND ends_with('/' || regexp_replace(f.path, '\\.wav$', ''), '/' || w.bare)),
best AS (SELECT *, min(diff) OVER (PARTITION BY ref) AS top FROM cand),
tied AS (SELECT ref, path FROM best WHERE diff = top),
cnt AS (SELECT ref, count(*) AS n, min(path) AS path FROM tied GROUP BY ref),
res AS (
  SELECT w.ref, coalesce(n, 0) AS n_best, CASE WHEN n = 1 THEN '{SOUNDS}/' || path END AS resolved_path,
         CASE WHEN n IS NULL THEN 'Sound ''' || w.ref || ''' was not found under {SOUNDS}'
              WHEN n > 1 THEN 'Sound ''' || w.ref || ''' matched multiple files under {SOUNDS}' END AS error
  FROM wanted w LEFT JOIN cnt ON cnt.ref = w.ref WHERE w.ref NOT LIKE '/%'
  UNION ALL
  SELECT w.ref, CASE WHEN f.path IS NULL THEN 0 ELSE 1 END, CASE WHEN f.path IS NOT NULL THEN w.ref END,
         CASE WHEN f.path IS NULL THEN 'Sound ''' || w.ref || ''' was not found as an absolute path' END
  FROM wanted w LEFT JOIN files f ON w.ref = '{SOUNDS}/' || f.path WHERE w.ref LIKE '/%')"""

ORACLE = {
    "voice_catalog": f"WITH {_VOICES} SELECT key, path FROM catalog",
    "available_voices": f"WITH {_VOICES} SELECT DISTINCT nm AS name FROM ok",
    "voice_resolve": f"""WITH {_VOICES}
SELECT c_custkey, voice_name, resolved_path, prio FROM refs LEFT JOIN res USING (voice_name)""",
    "voice_missing": f"""WITH {_VOICES}
SELECT voice_name, 'Voice ''' || voice_name || ''' was not found in {VOICES}' AS message
FROM wanted WHERE voice_name NOT IN (SELECT voice_name FROM res)""",
    "sound_resolve": f"WITH {_SOUNDS} SELECT * FROM res",
    "sound_ambiguous": f"""WITH {_SOUNDS}
SELECT DISTINCT bare AS tail, path FROM tied JOIN wanted USING (ref) WHERE ref IN (SELECT ref FROM cnt WHERE n > 1)""",
    "sound_uses": f"""WITH {_SOUNDS}
SELECT resolved_path AS path, page_id, length(resolved_path)::BIGINT * 100 AS frames
FROM refs JOIN res USING (ref) WHERE resolved_path IS NOT NULL""",
    "sounds_root": f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/library'
  ELSE regexp_replace('/' || {_PAGE} || '.xml', '/?[^/]*$', '') || CASE WHEN {_PAGE} LIKE '%/%' THEN '/sounds' ELSE 'sounds' END END AS root
FROM pages""",
}
