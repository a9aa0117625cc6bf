"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuesheet.llm import (
    chat, collocations, cotrain, decontaminate, langid, merkle, minhash, pieces, pii, quality, sharding, simhash, warc,
)  # fmt: skip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return cotrain.score(documents, cotrain.fit(documents, _table(spark, sf_dir, "labels")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), ["doc_id"], sharding.names())
    return placed.select("doc_id", "slot", "shard")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(documents))
    found = langid.identify(documents, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return quality.assess(_table(spark, sf_dir, "documents"), trusted)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.tampered_text())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SQL_OP2 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM r JOIN edges e ON r.b = e.a)
  SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reach USING (doc_id)"""

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {k * 5 + 1}, 5))::BIGINT >> {s}) & 31)::BIGINT + 1, 1)"
    for k in range(8)
    for s in (15, 10, 5, 0)
)
_SQL_OP5 = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS low FROM hashed GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> low THEN low END AS refers_to, NULL::VARCHAR AS error
FROM hashed JOIN firsts USING (h)"""

_SQL_OP8 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS t
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
       (SELECT DISTINCT n FROM win) s
  WHERE i + s.n - 1 <= len(w)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN win ON win.t = p.t AND win.n = p.n),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""

_CRC = (
    "xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT),"
    " lambda c, b: list_reduce(range(8), lambda v, q: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END),"
    " xor(c, b)), 4294967295))"
)


def _sql_leaf(text: str) -> str:
    values = [f"{c}::VARCHAR" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


_SQL_OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, {_sql_leaf("text")} AS leaf,
         {_sql_leaf(f"CASE WHEN {_CRC} % 5 = 0 THEN {_LOWER.format('text')} ELSE text END")} AS seen
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY k) AS n
  FROM leaves),
tree AS (
  SELECT k, n, 1::BIGINT AS w, pos AS i, leaf AS h FROM placed
  UNION ALL
  SELECT k, n, w * 16, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE w < n GROUP BY k, n, w, i // 16),
tops AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, h FROM tree WHERE w >= n),
upper_tree AS (
  SELECT n, 1::BIGINT AS w, pos AS i, h FROM tops
  UNION ALL
  SELECT n, w * 16, i // 16, sha256(string_agg(h, '' ORDER BY i)) FROM upper_tree WHERE w < n GROUP BY n, w, i // 16),
steps AS (
  SELECT x.k, x.w, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM tree x JOIN tree y ON x.k = y.k AND x.w = y.w AND x.i // 16 = y.i // 16 WHERE x.w < x.n GROUP BY ALL),
upper_steps AS (
  SELECT x.w, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS l,
         coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS r
  FROM upper_tree x JOIN upper_tree y ON x.w = y.w AND x.i // 16 = y.i // 16 WHERE x.w < x.n GROUP BY ALL),
ways AS (
  SELECT p.k, p.pos, 0 AS part, s.w, l, r FROM placed p JOIN steps s ON s.k = p.k AND s.i = p.pos // s.w
  UNION ALL
  SELECT p.k, p.pos, 1, s.w, l, r FROM placed p JOIN tops t ON t.k = p.k JOIN upper_steps s ON s.i = t.pos // s.w),
proofs AS (
  SELECT k, pos, string_agg(l || r, '' ORDER BY part, w) AS proof, list({{'l': l, 'r': r}} ORDER BY part, w) AS way
  FROM ways GROUP BY k, pos)
SELECT p.doc_id, p.leaf, t.h AS subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root,
       folded = root AS verified
FROM placed p JOIN tops t ON t.k = p.k LEFT JOIN proofs f ON f.k = p.k AND f.pos = p.pos,
     (SELECT h AS root FROM upper_tree WHERE w >= n) u,
     LATERAL (SELECT list_reduce(coalesce(way, []), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}},
                                 {{'l': p.seen, 'r': ''}}).l AS folded) v"""

_SQL_OP13 = rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?
-]+')) AS p FROM texts),
words AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS g
  FROM words, range(1, 6) s(m) WHERE len(w) >= m),
f AS (SELECT lang, m, g, string_split(g, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, m, g HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, n, k, x.f AS l, y.f AS r, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c JOIN sizes USING (lang)
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(c.w[1 : k], ' ')
  JOIN f y ON y.lang = c.lang AND y.g = array_to_string(c.w[k + 1 : ], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS g, max(f) AS most
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM f WHERE m > 2))
  GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.g = b.g WHERE coalesce(most, 0) < a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n,
       score::BIGINT AS score
FROM kept QUALIFY rank <= 2000"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_personal_data": op3_personal_data,
    "op4_sharding": op4_sharding,
    "op5_warc": op5_warc,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_chat": op9_chat,
    "op10_pieces": op10_pieces,
    "op11_simhash": op11_simhash,
    "op12_manifest": op12_manifest,
    "op13_collocations": op13_collocations,
}
ORACLE = {"op2_minhash": _SQL_OP2, "op5_warc": _SQL_OP5, "op8_decontamination": _SQL_OP8, "op12_manifest": _SQL_OP12, "op13_collocations": _SQL_OP13}
