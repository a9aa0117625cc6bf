"""Alignment of documents with words and clauses derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as T
from cuesheet.functions.timing import clean_zero
from cuesheet.operators import alignment as A
from cuesheet.registry.common import LB, RATE, documents, sql_round, sql_strip, table
from cuesheet.session import stored

STEP = 0.4
SECONDS = 0.0314159265358979


def scripts(spark, sf_dir):
    """Documents as scripts, with all their arrays."""
    parts, fine, words = script_parts(spark, sf_dir)
    return parts.select("doc_id", "lines", "coarse", fine.alias("fine"), words.alias("words"))


def script_parts(spark, sf_dir):
    """Documents as scripts with their coarse clauses, and expressions for their fine ones and words.

    Words are the text's tokens at 0.4 s each, every 7th misheard and some starts unknown. Coarse clauses
    are the lines, their sentences or pairs of lines, by document; fine clauses are sentences, of
    which some documents have the last ones with a word too many.
    """
    return parts_of(documents(spark, sf_dir))


def parts_of(docs):
    """``script_parts`` of some documents."""
    base = docs.select("doc_id", "text", T.stripped_lines(F.col("text")).alias("lines"))
    sentences = F.flatten(F.transform("lines", lambda l: F.split(l, "\\.")))
    pairs = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines"), F.lit(1)), F.lit(2)), lambda i: i <= F.size("lines")),
        lambda i: F.concat_ws(" ", F.slice("lines", i, F.lit(2))),
    )
    kind = F.col("doc_id") % 4
    texts = base.withColumn("sentences", sentences)
    coarse = F.when(kind == 0, F.col("lines")).when(kind == 1, F.col("sentences")).otherwise(pairs)
    fine = F.transform(
        "sentences",
        lambda t, i: F.when((kind == 3) & (i >= F.size("sentences") - 2), F.concat(t, F.lit(" extra"))).otherwise(t),
    )
    words = F.transform(
        T.tokens(F.col("text")),
        lambda t, i: F.struct(
            F.when(i % 7 == 6, F.concat(t, F.lit("zq"))).otherwise(t).alias("text"),
            F.when(i % 11 != 0, i * F.lit(STEP)).alias("start"),
            ((i + 1) * F.lit(STEP)).alias("end"),
            i.alias("pos"),
        ),
    )
    return texts.withColumn("coarse", _timed(coarse)), _timed(fine), words


def _timed(texts):
    def timed(found, ends):
        return F.transform(
            found,
            lambda t, i: F.struct(
                t.alias("text"),
                F.when(i % 5 != 2, F.get(ends, i) * F.lit(STEP)).alias("start"),
                F.when(i % 7 != 3, F.get(ends, i + 1) * F.lit(STEP)).alias("end"),
                (F.get(ends, i + 1) - F.get(ends, i)).alias("n"),
            ),
        )

    counts = lambda found: F.transform(found, lambda t: F.size(T.raw_tokens(t)))
    # One expression of the texts, so that a stage that few scripts reach is made for few.
    return A.let(lambda found: A.let(timed, found=found, ends=A.cumulative(counts(found))), found=texts)


def fallback_clauses(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "n_chars", T.stripped_lines(F.col("text")).alias("lines"))
    shared = A.fallback_clauses(F.col("lines"), F.col("n_chars") * F.lit(SECONDS))
    clauses = A.unfold(docs, ["doc_id"], shared, "line_no", "c")
    return clauses.select(
        "doc_id",
        "line_no",
        clean_zero(F.col("c.start"), 6).alias("start_s"),
        clean_zero(F.col("c.end"), 6).alias("end_s"),
    )


def fallback_words(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "n_chars", T.stripped_lines(F.col("text")).alias("lines"))
    words = A.fallback_word_rows(docs, ["doc_id"], F.col("lines"), F.col("n_chars") * F.lit(SECONDS))
    return words.select(
        "doc_id",
        "pos",
        F.col("text").alias("token"),
        clean_zero(F.col("start"), 5).alias("start_s"),
        clean_zero(F.col("end"), 5).alias("end_s"),
    )


def word_tokens(spark, sf_dir):
    # Words here are white-space separated pieces, which may hold no token or several.
    docs = documents(spark, sf_dir).select("doc_id", F.split("text", " ").alias("pieces"))
    words = F.transform(
        "pieces",
        lambda p, i: F.struct(p.alias("text"), (i * F.lit(0.5)).alias("start"), ((i + 1) * F.lit(0.5)).alias("end")),
    )
    tokens = A.unfold(docs, ["doc_id"], A.word_tokens(words), "pos", "t")
    return tokens.select(
        "doc_id", "pos", "t.token", F.col("t.start").alias("start_s"), F.col("t.end").alias("end_s")
    )


def exact_clauses(spark, sf_dir):
    # Spans are null where the clauses are not exact; a filter would be pushed down and run it all twice.
    found = A.with_offsets(scripts(spark, sf_dir), "coarse")
    args = [F.col("line_ends"), F.col("clause_ranges")]
    spans = F.when(A.is_exact(*args), A.exact_spans(F.col("line_tokens"), *args))
    return A.unfold(found, ["doc_id"], spans, "line_no", "s").select(
        "doc_id",
        "line_no",
        clean_zero(F.col("s.start"), 6).alias("start_s"),
        clean_zero(F.col("s.end"), 6).alias("end_s"),
    )


def alignment_decision(spark, sf_dir):
    parts, fine, words = script_parts(spark, sf_dir)
    some = parts.withColumn("coarse", F.when(F.col("doc_id") % 10 != 9, F.col("coarse")))
    return A.decide(some.withColumns({"fine": fine, "words": words})).select("doc_id", "decision")


def fine_stage(spark, sf_dir):
    inputs = stored(scripts(spark, sf_dir).select("doc_id", "lines", "coarse"), "scripts")
    return A.needs_fine_stage(inputs).select("doc_id", F.size("lines").cast("bigint").alias("n_lines"))


def _spans(spark, sf_dir):
    return A.aligned_spans(*script_parts(spark, sf_dir))


def line_spans(spark, sf_dir):
    spans = _spans(spark, sf_dir).withColumn("filled", A.fill_gaps(F.col("spans")))
    both = A.unfold(spans, ["doc_id", "decision"], F.arrays_zip("spans", "filled"), "line_no", "s")
    return both.select(
        "doc_id",
        "decision",
        "line_no",
        clean_zero(F.col("s.spans.start"), 6).alias("raw_start"),
        clean_zero(F.col("s.spans.end"), 6).alias("raw_end"),
        clean_zero(F.col("s.filled.start"), 6).alias("start_s"),
        clean_zero(F.col("s.filled.end"), 6).alias("end_s"),
    )


def greedy_align(spark, sf_dir):
    prepared = scripts(spark, sf_dir).select(
        "doc_id",
        A.line_tokens(F.col("lines")).alias("lt"),
        F.concat(F.lit(" "), F.array_join(F.transform("words", lambda w: w["text"]), " "), F.lit(" ")).alias("joined"),
    )
    hits = A.unfold(prepared, ["doc_id"], A.greedy_hits(F.col("lt"), F.col("joined")), "line_no", "h")
    return hits.select(
        "doc_id",
        "line_no",
        F.col("h.first").cast("bigint").alias("first_token"),
        F.col("h.last").cast("bigint").alias("last_token"),
    )


def _positions(spark, sf_dir):
    # An inline item stands before the first line, after every fourth line and after the last.
    n = F.size("lines")
    before = F.filter(F.sequence(F.lit(0), n), lambda k: (k % 4 == 0) | (k == n))
    return _spans(spark, sf_dir).select(
        "doc_id",
        A.inline_positions(A.fill_gaps(F.col("spans")), before).alias("positions"),
        (F.size("words") * F.lit(RATE) / 4).cast("bigint").alias("frames"),
    )


def inline_positions(spark, sf_dir):
    rows = A.unfold(_positions(spark, sf_dir), ["doc_id"], F.col("positions"), "item_no", "p")
    return rows.select("doc_id", "item_no", clean_zero(F.col("p"), 6).alias("start_s"))


def marker_frames(spark, sf_dir):
    frames = A.marker_frames(F.col("positions"), F.col("frames"), RATE)
    marked = A.unfold(_positions(spark, sf_dir), ["doc_id"], frames, "marker_no", "frame")
    return marked.select("doc_id", "marker_no", "frame")


def token_run_match(spark, sf_dir):
    return A.token_runs(
        documents(spark, sf_dir).select("doc_id", "text"),
        "doc_id",
        table(spark, sf_dir, "benchmark").select("item_id", "text"),
        "item_id",
    )


QUERIES = {
    "fallback_clauses": fallback_clauses,
    "fallback_words": fallback_words,
    "word_tokens": word_tokens,
    "exact_clauses": exact_clauses,
    "alignment_decision": alignment_decision,
    "fine_stage": fine_stage,
    "greedy_align": greedy_align,
    "line_spans": line_spans,
    "inline_positions": inline_positions,
    "marker_frames": marker_frames,
    "token_run_match": token_run_match,
}

_TOK = "list_transform(regexp_extract_all({}, '[A-Za-z0-9'']+'), lambda t: lower(t))"
_NTOK = "len(regexp_extract_all({}, '[A-Za-z0-9'']+'))::BIGINT"


def _tok(x):
    return _TOK.format(x)


def _ntok(x):
    return _NTOK.format(x)


_LINES = f"""
docs AS (
  SELECT doc_id, n_chars, text, list_filter(list_transform(regexp_split_to_array(text, {LB}),
      lambda x: {sql_strip('x')}), lambda x: x <> '') AS l FROM documents),
ln AS (SELECT doc_id, n_chars, generate_subscripts(l, 1)::BIGINT - 1 AS line_no, unnest(l) AS line FROM docs),
lt AS (
  SELECT *, {_tok('line')} AS tk FROM ln),
lo AS (
  SELECT *, len(tk)::BIGINT AS n, sum(len(tk)) OVER w::BIGINT AS hi, (sum(len(tk)) OVER w)::BIGINT - len(tk) AS lo
  FROM lt WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""

_FALLBACK = f"""{_LINES},
fb AS (
  SELECT doc_id, line_no, line, tk, n_chars * {SECONDS}::DOUBLE AS d, greatest(n, 1) AS n1,
         sum(greatest(n, 1)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS c,
         sum(greatest(n, 1)) OVER (PARTITION BY doc_id) AS total
  FROM lo),
fc AS (SELECT *, d * (c - n1)::DOUBLE / total AS s, d * c::DOUBLE / total AS e FROM fb)"""

_CLAUSES = f"""{_LINES},
sentence AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS idx, s AS txt FROM (
    SELECT doc_id, line_no, generate_subscripts(string_split(line, '.'), 1) AS k, unnest(string_split(line, '.')) AS s FROM ln)),
pair AS (
  SELECT doc_id, line_no // 2 AS idx, string_agg(line, ' ' ORDER BY line_no) AS txt FROM ln GROUP BY doc_id, line_no // 2),
coarse_text AS (
  SELECT doc_id, line_no AS idx, line AS txt FROM ln WHERE doc_id % 4 = 0
  UNION ALL SELECT * FROM sentence WHERE doc_id % 4 = 1
  UNION ALL SELECT * FROM pair WHERE doc_id % 4 IN (2, 3)),
fine_text AS (
  SELECT doc_id, idx, CASE WHEN doc_id % 4 = 3 AND idx >= n - 2 THEN txt || ' extra' ELSE txt END AS txt
  FROM sentence JOIN (SELECT doc_id, count(*) AS n FROM sentence GROUP BY doc_id) c USING (doc_id)),
staged AS (SELECT 'coarse' AS stage, * FROM coarse_text UNION ALL SELECT 'fine', * FROM fine_text),
ranged AS (
  SELECT *, {_tok('txt')} AS tk, sum({_ntok('txt')}) OVER w::BIGINT AS hi,
         (sum({_ntok('txt')}) OVER w)::BIGINT - {_ntok('txt')} AS lo
  FROM staged WINDOW w AS (PARTITION BY stage, doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
clause AS (
  SELECT *, CASE WHEN idx % 5 <> 2 THEN lo * {STEP}::DOUBLE END AS s, CASE WHEN idx % 7 <> 3 THEN hi * {STEP}::DOUBLE END AS e
  FROM ranged),
bad AS (
  SELECT st.stage, lo.doc_id, count(*) FILTER (c.doc_id IS NULL AND lo.hi > 0) AS n_bad, max(lo.hi) AS total
  FROM (VALUES ('coarse'), ('fine')) AS st(stage) CROSS JOIN lo
  LEFT JOIN (SELECT DISTINCT stage, doc_id, hi FROM clause) c
    ON c.stage = st.stage AND c.doc_id = lo.doc_id AND c.hi = lo.hi
  GROUP BY st.stage, lo.doc_id),
exact AS (
  SELECT b.stage, b.doc_id, n_bad = 0 AND b.total = coalesce(t.total, 0) AS ok
  FROM bad b LEFT JOIN (SELECT stage, doc_id, max(hi) AS total FROM clause GROUP BY stage, doc_id) t
    ON t.stage = b.stage AND t.doc_id = b.doc_id),
decision AS (
  SELECT d.doc_id, CASE WHEN coalesce(a.ok, true) THEN 'transcription_exact_clause_match'
       WHEN coalesce(f.ok, true) THEN 'aligned_exact_clause_match' ELSE 'aligned_word_matching' END AS decision
  FROM docs d LEFT JOIN exact a ON a.doc_id = d.doc_id AND a.stage = 'coarse'
  LEFT JOIN exact f ON f.doc_id = d.doc_id AND f.stage = 'fine')"""

_WORDS = f"""
alltok AS (
  SELECT doc_id, generate_subscripts(tk, 1)::BIGINT - 1 AS pos, unnest(tk) AS token
  FROM (SELECT doc_id, {_tok('text')} AS tk FROM documents)),
words AS (
  SELECT doc_id, pos AS w, CASE WHEN pos % 7 = 6 THEN token || 'zq' ELSE token END AS token,
         CASE WHEN pos % 11 <> 0 THEN pos * {STEP}::DOUBLE END AS s, (pos + 1) * {STEP}::DOUBLE AS e
  FROM alltok),
wl AS (SELECT doc_id, ' ' || string_agg(token, ' ' ORDER BY w) || ' ' AS j FROM words GROUP BY doc_id)"""

# The frontier holds one row per document; each step moves every document on by one line.
_GREEDY = """
pat AS MATERIALIZED (
  SELECT lo.doc_id, line_no, n, ' ' || array_to_string(tk, ' ') || ' ' AS p FROM lo),
wj AS MATERIALIZED (SELECT d.doc_id, coalesce(j, '  ') AS j FROM docs d LEFT JOIN wl USING (doc_id)),
walk AS (
  SELECT doc_id, -1::BIGINT AS line_no, 1::BIGINT AS cur, NULL::BIGINT AS pos, 0::BIGINT AS n FROM docs
  UNION ALL
  SELECT doc_id, line_no, CASE WHEN hit > 0 AND n > 0 THEN cur + hit - 1 + length(p) - 1 ELSE cur END,
         CASE WHEN hit > 0 AND n > 0 THEN cur + hit - 1 END, n
  FROM (SELECT w.doc_id, p.line_no, w.cur, p.n, p.p, strpos(substr(j.j, w.cur), p.p) AS hit
        FROM walk w JOIN pat p ON p.doc_id = w.doc_id AND p.line_no = w.line_no + 1
        JOIN wj j ON j.doc_id = w.doc_id)),
hits AS (
  SELECT walk.doc_id, line_no,
         CASE WHEN pos IS NOT NULL THEN len(string_split(substr(j, 1, pos - 1), ' ')) - 1 END::BIGINT AS first_token,
         CASE WHEN pos IS NOT NULL THEN len(string_split(substr(j, 1, pos - 1), ' ')) - 2 + n END::BIGINT AS last_token
  FROM walk JOIN wj ON wj.doc_id = walk.doc_id WHERE line_no >= 0)"""

_SPANS = f"""{_CLAUSES}, {_WORDS}, {_GREEDY},
used AS (
  SELECT c.* FROM clause c JOIN decision d USING (doc_id)
  WHERE stage = CASE WHEN decision = 'transcription_exact_clause_match' THEN 'coarse' ELSE 'fine' END),
ex AS (
  SELECT lo.doc_id, lo.line_no, arg_min(u.s, u.idx) FILTER (u.s IS NOT NULL) AS s,
         arg_max(u.e, u.idx) FILTER (u.e IS NOT NULL) AS e
  FROM lo LEFT JOIN used u ON u.doc_id = lo.doc_id AND u.hi > lo.lo AND u.hi <= lo.hi AND u.hi > u.lo
  GROUP BY lo.doc_id, lo.line_no),
op AS (SELECT doc_id, lo, tk, s FROM used WHERE hi > lo),
cl AS (SELECT doc_id, hi, arg_max(tk, idx) AS tk, arg_max(struct_pack(e := e), idx).e AS e FROM used GROUP BY doc_id, hi),
mt AS (
  SELECT lo.doc_id, lo.line_no,
         coalesce(CASE WHEN list_slice(lo.tk, 1, len(op.tk)) = op.tk THEN op.s END, a.s) AS s,
         coalesce(CASE WHEN len(cl.tk) > 0 AND len(cl.tk) <= lo.n
                        AND list_slice(lo.tk, lo.n - len(cl.tk) + 1, lo.n) = cl.tk THEN cl.e END, z.e) AS e
  FROM lo LEFT JOIN op ON op.doc_id = lo.doc_id AND op.lo = lo.lo
  LEFT JOIN cl ON cl.doc_id = lo.doc_id AND cl.hi = lo.hi
  LEFT JOIN hits h ON h.doc_id = lo.doc_id AND h.line_no = lo.line_no
  LEFT JOIN words a ON a.doc_id = h.doc_id AND a.w = h.first_token
  LEFT JOIN words z ON z.doc_id = h.doc_id AND z.w = h.last_token),
spans AS (
  SELECT d.doc_id, decision, ex.line_no,
         CASE WHEN decision = 'aligned_word_matching' THEN mt.s ELSE ex.s END AS s,
         CASE WHEN decision = 'aligned_word_matching' THEN mt.e ELSE ex.e END AS e
  FROM decision d JOIN ex ON ex.doc_id = d.doc_id JOIN mt ON mt.doc_id = ex.doc_id AND mt.line_no = ex.line_no),
known AS (
  SELECT *, last_value(coalesce(e, s) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM spans),
filled AS (
  SELECT *, coalesce(s, prev, 0.0) AS fs, coalesce(e, s, prev, 0.0) AS fe FROM known)"""

_POSITIONS = f"""{_SPANS},
cnt AS (
  SELECT docs.doc_id, len(l)::BIGINT AS n,
         (CASE WHEN decision = 'aligned_word_matching' THEN coalesce(c.w, 0) ELSE 0 END * {RATE} / 4)::BIGINT AS frames
  FROM docs JOIN decision USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS w FROM words GROUP BY doc_id) c USING (doc_id)),
cuts AS (
  SELECT doc_id, n, frames, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS item_no
  FROM (SELECT doc_id, n, frames, unnest(range(n + 1)) AS k FROM cnt) WHERE k % 4 = 0 OR k = n),
pos AS (
  SELECT c.doc_id, item_no, frames,
         CASE WHEN k = 0 THEN 0.0 WHEN b.doc_id IS NULL THEN a.fe ELSE (a.fe + b.fs) / 2 END::DOUBLE AS p
  FROM cuts c LEFT JOIN filled a ON a.doc_id = c.doc_id AND a.line_no = k - 1
  LEFT JOIN filled b ON b.doc_id = c.doc_id AND b.line_no = k)"""

ORACLE = {
    "fallback_clauses": f"""WITH {_FALLBACK}
SELECT doc_id, line_no, {sql_round('s', 6)} AS start_s, {sql_round('e', 6)} AS end_s FROM fc""",
    "fallback_words": f"""WITH {_FALLBACK},
w AS (
  SELECT doc_id, line_no, s, e, n1, generate_subscripts(t, 1) - 1 AS k, unnest(t) AS token
  FROM (SELECT *, CASE WHEN len(tk) = 0 THEN [''] ELSE tk END AS t FROM fc))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS pos, token,
       {sql_round('s + k * ((e - s) / n1)', 5)} AS start_s, {sql_round('s + (k + 1) * ((e - s) / n1)', 5)} AS end_s FROM w""",
    "word_tokens": f"""
WITH p AS (
  SELECT doc_id, generate_subscripts(x, 1)::BIGINT - 1 AS i, unnest(x) AS piece
  FROM (SELECT doc_id, string_split(text, ' ') AS x FROM documents)),
t AS (SELECT doc_id, i, generate_subscripts(tk, 1) AS k, unnest(tk) AS token FROM (SELECT doc_id, i, {_tok('piece')} AS tk FROM p))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS pos, token,
       i * 0.5::DOUBLE AS start_s, (i + 1) * 0.5::DOUBLE AS end_s FROM t""",
    "exact_clauses": f"""WITH {_CLAUSES},
ex AS (
  SELECT lo.doc_id, lo.line_no, arg_min(u.s, u.idx) FILTER (u.s IS NOT NULL) AS s,
         arg_max(u.e, u.idx) FILTER (u.e IS NOT NULL) AS e
  FROM lo JOIN exact x ON x.doc_id = lo.doc_id AND x.stage = 'coarse' AND x.ok
  LEFT JOIN clause u ON u.stage = 'coarse' AND u.doc_id = lo.doc_id AND u.hi > lo.lo AND u.hi <= lo.hi AND u.hi > u.lo
  GROUP BY lo.doc_id, lo.line_no)
SELECT doc_id, line_no, {sql_round('s', 6)} AS start_s, {sql_round('e', 6)} AS end_s FROM ex""",
    "alignment_decision": f"""WITH {_CLAUSES}
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'fallback' ELSE decision END AS decision FROM decision""",
    "fine_stage": f"""WITH {_CLAUSES}
SELECT doc_id, len(l)::BIGINT AS n_lines FROM docs JOIN decision USING (doc_id)
WHERE decision <> 'transcription_exact_clause_match'""",
    "greedy_align": f"""WITH RECURSIVE {_LINES}, {_WORDS}, {_GREEDY}
SELECT doc_id, line_no, first_token, last_token FROM hits""",
    "line_spans": f"""WITH RECURSIVE {_SPANS}
SELECT doc_id, decision, line_no, {sql_round('s', 6)} AS raw_start, {sql_round('e', 6)} AS raw_end,
       {sql_round('fs', 6)} AS start_s, {sql_round('fe', 6)} AS end_s FROM filled""",
    "inline_positions": f"""WITH RECURSIVE {_POSITIONS}
SELECT doc_id, item_no, {sql_round('p', 6)} AS start_s FROM pos""",
    "marker_frames": f"""WITH RECURSIVE {_POSITIONS},
m AS (
  SELECT doc_id, item_no + 1 AS marker_no, frames, least(greatest(p, 0.0), frames / {RATE}.0::DOUBLE) AS t FROM pos
  UNION ALL SELECT doc_id, 0, frames, 0.0 FROM cnt
  UNION ALL SELECT c.doc_id, (SELECT count(*) FROM cuts q WHERE q.doc_id = c.doc_id) + 1, frames, frames / {RATE}.0::DOUBLE FROM cnt c)
SELECT doc_id, marker_no::BIGINT AS marker_no, least(frames, greatest(0, round_even(max(t) OVER (PARTITION BY doc_id ORDER BY marker_no
    ROWS UNBOUNDED PRECEDING) * {RATE}, 0)::BIGINT)) AS frame FROM m""",
    "token_run_match": f"""
WITH d AS (SELECT doc_id, ' ' || array_to_string({_tok('text')}, ' ') || ' ' AS j FROM documents),
b AS (SELECT item_id, {_tok('text')} AS tk, ' ' || array_to_string({_tok('text')}, ' ') || ' ' AS p FROM benchmark),
h AS (SELECT doc_id, item_id, p, j, tk FROM d, b WHERE len(tk) > 0 AND contains(j, p)),
e AS (
  SELECT doc_id, item_id, p, k, substr(j, off::BIGINT, length(p)) AS x FROM (
    SELECT doc_id, item_id, p, j, unnest(range(len(string_split(j, ' ')) - 2)) AS k FROM h) q,
    LATERAL (SELECT 1 + coalesce(list_sum(list_transform(string_split(j, ' ')[1:k + 1], lambda s: length(s) + 1)), 0) - 1 AS off))
SELECT doc_id, item_id, k::BIGINT AS pos FROM e WHERE x = p""",
}
