"""Timelines over conversations, embeddings and the region hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as T
from cuesheet.functions.timing import clean_zero, overrides, to_frames, to_seconds
from cuesheet.operators import dialogue as D
from cuesheet.operators import timeline as L
from cuesheet.registry.common import RATE, script_parts, sql_items, sql_ntok, sql_round, table
from cuesheet.session import stored

HOP = 48


def children(spark, sf_dir):
    """Turns as clips: 0.4 s per token, authored gaps by turn, a default lead-in for answers."""
    turn = F.col("turn")
    pre = F.when(turn % 5 == 1, -0.25).when(turn % 5 == 3, 0.1).otherwise(0.0)
    post = F.when(turn % 4 == 2, -0.35).when(turn % 4 == 1, 0.05).otherwise(0.0)
    clips = table(spark, sf_dir, "conversations").select(
        "conv_id",
        turn.alias("idx"),
        F.col("role").alias("label"),
        (T.token_count(F.col("text")) * F.lit(RATE * 2) / 5).cast("bigint").alias("frames"),
        overrides(pre, F.when(F.col("role") == "assistant", 0.05).otherwise(0.0)).alias("pre_gap"),
        post.alias("post_gap"),
        F.when(turn % 7 == 3, 1.5).cast("double").alias("length"),
        F.when(turn % 2 == 0, 0.2).otherwise(0.3).alias("pre_margin"),
        (turn.cast("double") / 10).alias("post_margin"),
    )
    return clips


def _placed(spark, sf_dir):
    return L.place(children(spark, sf_dir), ["conv_id"], RATE)


def timeline_placement(spark, sf_dir):
    return _placed(spark, sf_dir).select(
        "conv_id", "idx", "frames", "occupied", "cursor", "start_frame", "end_frame"
    )


def conversation_cues(spark, sf_dir):
    """The whole way from text to cues: turns of each conversation, timed by tokens and placed."""
    parts = script_parts(table(spark, sf_dir, "conversations"), False)
    turns = stored(D.turns(D.items(D.dialogue_lines(parts, ["conv_id"]), ["conv_id"])), "turns")
    clips = turns.select(
        "conv_id",
        F.col("item").alias("idx"),
        "speaker_key",
        "spoken_text",
        (T.token_count(F.col("spoken_text")) * F.lit(RATE * 2) / 5).cast("bigint").alias("frames"),
        F.lit(0.0).alias("pre_gap"),
        F.when(F.col("speaker_key") == "user", 0.5).otherwise(0.25).alias("post_gap"),
        F.lit(None).cast("double").alias("length"),
    )
    placed = L.place(clips, ["conv_id"], RATE)
    return placed.select("conv_id", "idx", "speaker_key", "start_frame", "end_frame", "spoken_text")


def composite_summary(spark, sf_dir):
    out = L.summarise(_placed(spark, sf_dir), ["conv_id"], RATE)
    return out.select(
        "conv_id",
        "min_start",
        "max_end",
        "cursor_end",
        "n_children",
        "pre_margin",
        "post_margin",
        "frames",
        clean_zero(F.col("pre_gap"), 6).alias("pre_gap"),
        clean_zero(F.col("post_gap"), 6).alias("post_gap"),
    )


def boundary_trim(spark, sf_dir):
    summary = L.summarise(_placed(spark, sf_dir), ["conv_id"], RATE)
    return L.trim_to_boundary(summary, RATE).select(
        "conv_id", "frames", "trim_start", "trim_end", "lead_frames", "tail_frames", "final_frames"
    )


def placement_report(spark, sf_dir):
    return L.placement_report(_placed(spark, sf_dir), RATE).select("conv_id", "idx", "message")


def frame_rounding(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    # Half quantities make ties, which go to the even frame.
    seconds = F.col("l_quantity") / 2
    return lineitem.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).select(
        "l_quantity",
        "n",
        to_frames(seconds, 1).alias("frames"),
        clean_zero(to_seconds(to_frames(F.col("l_quantity") * 0.37, 48000), 48000), 6).alias("seconds"),
    )


def hierarchy(spark, sf_dir):
    """Region -> nation -> customer as a plan tree of three levels."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    none = F.lit(None).cast("double")
    root = region.select(
        F.col("r_regionkey").cast("bigint").alias("production"),
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).alias("depth"),
        F.lit(0).cast("bigint").alias("idx"),
        F.lit(True).alias("is_container"),
        F.lit(0).cast("bigint").alias("frames"),
        F.lit(0.0).alias("pre_gap"),
        F.lit(0.0).alias("post_gap"),
        none.alias("length"),
    )
    key = F.col("n_nationkey")
    middle = nation.select(
        F.col("n_regionkey").cast("bigint").alias("production"),
        F.concat(F.lit("n"), key.cast("string")).alias("node_id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"),
        F.lit(1).alias("depth"),
        key.cast("bigint").alias("idx"),
        F.lit(True).alias("is_container"),
        F.lit(0).cast("bigint").alias("frames"),
        F.when(key % 3 == 0, 0.5).otherwise(0.0).alias("pre_gap"),
        F.when(key % 4 == 1, -0.25).otherwise(0.0).alias("post_gap"),
        F.when(key % 6 == 5, 20.0).cast("double").alias("length"),
    )
    # The production of a customer is its nation's region; nations are a fixed list of 25.
    places = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    leaf = customer.join(F.broadcast(places), "c_nationkey").select(
        F.col("n_regionkey").cast("bigint").alias("production"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"),
        F.lit(2).alias("depth"),
        F.col("c_custkey").alias("idx"),
        F.lit(False).alias("is_container"),
        (F.col("c_custkey") % 100 + 1).alias("frames"),
        F.when(F.col("c_custkey") % 5 == 0, -1.0).otherwise(0.25).alias("pre_gap"),
        F.lit(0.5).alias("post_gap"),
        F.when(F.col("c_custkey") % 11 == 0, 2.0).cast("double").alias("length"),
    )
    return root.unionByName(middle).unionByName(leaf)


def nested_timeline(spark, sf_dir):
    placements, _ = L.compose_tree(hierarchy(spark, sf_dir), 4, 2)
    return placements.select("production", "node_id", "frames", "start_frame", "abs_start")


def nested_summary(spark, sf_dir):
    _, summaries = L.compose_tree(hierarchy(spark, sf_dir), 4, 2)
    return summaries.select(
        "production", "node_id", "min_start", "max_end", "cursor_end", "n_children", "frames"
    )


def tree_leaves(spark, sf_dir):
    found = L.leaves(hierarchy(spark, sf_dir))
    return found.select("production", "node_id", "depth")


def clips(spark, sf_dir):
    """Embeddings as mono clips of 64 frames; the label is the container."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("label"), F.col("vec_id").alias("idx"), F.col("embedding").alias("samples")
    )


def _overlapping(spark, sf_dir):
    sized = clips(spark, sf_dir).select(
        "*",
        F.size("samples").cast("bigint").alias("frames"),
        F.lit(0.0).alias("pre_gap"),
        F.when(F.col("idx") % 10 == 0, 0.5).otherwise(0.0).alias("post_gap"),
        # Every tenth clip leaves a gap of half a second, the others overlap the next one.
        F.when(F.col("idx") % 10 != 0, F.lit(float(HOP)) / 100).alias("length"),
    )
    return L.place(sized, ["label"], 100)


def mix_overlap(spark, sf_dir):
    mixed = L.mix(_overlapping(spark, sf_dir), ["label"])
    return mixed.select("label", "frame", clean_zero(F.col("value"), 6).alias("value"))


def mix_with_silence(spark, sf_dir):
    placed = _overlapping(spark, sf_dir)
    lengths = L.summarise(placed, ["label"], 100).select("label", "frames")
    full = L.with_silence(L.mix(placed, ["label"]), lengths, ["label"])
    return full.select("label", "frame", clean_zero(F.col("value"), 6).alias("value"))


def _samples(df, *extra):
    return df.select(
        "idx", *extra, F.posexplode("samples").alias("frame", "v")
    ).select(
        "idx", *extra, F.col("frame").cast("bigint").alias("frame"), clean_zero(F.col("v").cast("double"), 6).alias("value")
    )


def slice_time(spark, sf_dir):
    start = (F.col("idx") % 50).cast("double") / 100
    end = F.when(F.col("idx") % 13 == 0, start - 0.05).otherwise(start + 0.105)
    return _samples(L.slice_time(clips(spark, sf_dir), start, end, 100))


def slice_from(spark, sf_dir):
    seconds = (F.col("idx") % 70).cast("double") / 100 + 0.006
    return _samples(L.slice_from(clips(spark, sf_dir), seconds, 100))


def _markers(spark, sf_dir):
    middle = (F.col("idx") * 7 % 80).cast("bigint")
    full = F.size("samples").cast("bigint")
    return clips(spark, sf_dir).select(
        "idx",
        F.array(F.lit(0).cast("bigint"), F.least(middle, full), F.greatest(F.least(middle, full), F.lit(40).cast("bigint")), full).alias(
            "frames"
        ),
    )


def slice_markers(spark, sf_dir):
    out = L.slice_markers(clips(spark, sf_dir), _markers(spark, sf_dir), "idx")
    return out.select(
        "idx",
        "slice_no",
        "first_frame",
        "last_frame",
        F.size("samples").cast("bigint").alias("frames"),
        clean_zero(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"),
    )


def splice_order(spark, sf_dir):
    slices = L.slice_markers(clips(spark, sf_dir), _markers(spark, sf_dir), "idx").select(
        F.col("idx").alias("clip"), "slice_no", F.size("samples").cast("bigint").alias("frames")
    )
    inline = clips(spark, sf_dir).select(
        F.col("idx").alias("clip"),
        F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("item_no"),
        F.lit(10).cast("bigint").alias("frames"),
    )
    spliced = L.splice(slices, inline, ["clip"])
    return L.concatenate(spliced, ["clip"]).select("clip", "idx", "frames", "start_frame")


def clip_durations(spark, sf_dir):
    measured = clips(spark, sf_dir).select("label", F.size("samples").cast("bigint").alias("frames"))
    return measured.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.sum("frames").alias("frames"),
        clean_zero(to_seconds(F.sum("frames"), 24000), 6).alias("seconds"),
        to_seconds(F.sum("frames"), 0).alias("unrated_seconds"),
    )


QUERIES = {
    "conversation_cues": conversation_cues,
    "timeline_placement": timeline_placement,
    "composite_summary": composite_summary,
    "boundary_trim": boundary_trim,
    "placement_report": placement_report,
    "frame_rounding": frame_rounding,
    "nested_timeline": nested_timeline,
    "nested_summary": nested_summary,
    "tree_leaves": tree_leaves,
    "mix_overlap": mix_overlap,
    "mix_with_silence": mix_with_silence,
    "slice_time": slice_time,
    "slice_from": slice_from,
    "slice_markers": slice_markers,
    "splice_order": splice_order,
    "clip_durations": clip_durations,
}

PLACED = f"""
ch AS (
  SELECT conv_id, turn AS idx, role AS label, ({sql_ntok('text')} * {RATE * 2} / 5)::BIGINT AS frames,
         CASE WHEN turn % 5 = 1 THEN -0.25 WHEN turn % 5 = 3 THEN 0.1
              WHEN role = 'assistant' THEN 0.05 ELSE 0.0 END::DOUBLE AS pre_gap,
         CASE WHEN turn % 4 = 2 THEN -0.35 WHEN turn % 4 = 1 THEN 0.05 ELSE 0.0 END::DOUBLE AS post_gap,
         CASE WHEN turn % 7 = 3 THEN 1.5 END::DOUBLE AS length,
         CASE WHEN turn % 2 = 0 THEN 0.2 ELSE 0.3 END::DOUBLE AS pre_margin, turn / 10.0::DOUBLE AS post_margin
  FROM conversations),
sized AS (
  SELECT *, round_even(pre_gap * {RATE}, 0)::BIGINT AS pre,
         coalesce(round_even(length * {RATE}, 0)::BIGINT,
                  round_even(pre_gap * {RATE}, 0)::BIGINT + frames + round_even(post_gap * {RATE}, 0)::BIGINT) AS occupied
  FROM ch),
cur AS (
  SELECT *, coalesce(sum(occupied) OVER (PARTITION BY conv_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor FROM sized),
placed AS (SELECT *, cursor + pre AS start_frame, cursor + pre + frames AS end_frame FROM cur),
summed AS (
  SELECT conv_id, least(0, min(start_frame)) AS min_start, greatest(0, max(end_frame)) AS max_end,
         sum(occupied)::BIGINT AS cursor_end, count(*) AS n_children,
         arg_min(pre_margin, idx) AS pre_margin, arg_max(post_margin, idx) AS post_margin
  FROM placed GROUP BY conv_id),
summary AS (
  SELECT *, greatest(0, max_end - min_start) AS frames, min_start / {RATE}.0::DOUBLE AS pre_gap,
         (cursor_end - max_end) / {RATE}.0::DOUBLE AS post_gap FROM summed)"""

_TREE = """
leaf AS (
  SELECT n_regionkey::BIGINT AS production, 'c' || c_custkey AS node_id, 'n' || c_nationkey AS parent_id,
         c_custkey AS idx, c_custkey % 100 + 1 AS frames,
         (CASE WHEN c_custkey % 5 = 0 THEN -4 ELSE 1 END)::BIGINT AS pre, 2::BIGINT AS post,
         CASE WHEN c_custkey % 11 = 0 THEN 8 END::BIGINT AS len
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
leaf_cur AS (
  SELECT *, coalesce(len, pre + frames + post) AS occ,
         coalesce(sum(coalesce(len, pre + frames + post)) OVER (PARTITION BY parent_id ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor FROM leaf),
leaf_sum AS (
  SELECT production, parent_id AS node_id, least(0, min(cursor + pre)) AS min_start,
         greatest(0, max(cursor + pre + frames)) AS max_end, sum(occ)::BIGINT AS cursor_end, count(*) AS n_children
  FROM leaf_cur GROUP BY production, parent_id),
mid AS (
  SELECT n_regionkey::BIGINT AS production, 'n' || n_nationkey AS node_id, 'r' || n_regionkey AS parent_id,
         n_nationkey::BIGINT AS idx, coalesce(max_end - min_start, 0) AS frames,
         CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE coalesce(min_start, 0) END AS pre,
         CASE WHEN n_nationkey % 4 = 1 THEN -1 ELSE coalesce(cursor_end - max_end, 0) END AS post,
         CASE WHEN n_nationkey % 6 = 5 THEN 80 END::BIGINT AS len, min_start
  FROM nation LEFT JOIN leaf_sum ON node_id = 'n' || n_nationkey),
mid_cur AS (
  SELECT *, coalesce(len, pre + frames + post) AS occ,
         coalesce(sum(coalesce(len, pre + frames + post)) OVER (PARTITION BY parent_id ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cursor FROM mid),
mid_sum AS (
  SELECT production, parent_id AS node_id, least(0, min(cursor + pre)) AS min_start,
         greatest(0, max(cursor + pre + frames)) AS max_end, sum(occ)::BIGINT AS cursor_end, count(*) AS n_children
  FROM mid_cur GROUP BY production, parent_id)"""

_MIX = f"""
c AS (
  SELECT label::BIGINT AS label, vec_id AS idx, embedding AS samples, 64 AS frames,
         CASE WHEN vec_id % 10 = 0 THEN 64 + 50 ELSE {HOP} END AS occ FROM embeddings),
p AS (
  SELECT *, coalesce(sum(occ) OVER (PARTITION BY label ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame FROM c),
e AS (
  SELECT label, start_frame + generate_subscripts(samples, 1) - 1 AS frame, unnest(samples)::DOUBLE AS v FROM p),
m AS (SELECT label, frame, sum(v) AS v FROM e GROUP BY label, frame)"""

_MARK = """
mk AS (
  SELECT vec_id AS idx, embedding AS samples,
         [0::BIGINT, least(vec_id * 7 % 80, 64), greatest(least(vec_id * 7 % 80, 64), 40), 64::BIGINT] AS f
  FROM embeddings),
sl AS (
  SELECT idx, k::BIGINT AS slice_no, f[k + 1] AS first_frame, greatest(f[k + 1], f[k + 2]) AS last_frame, samples
  FROM mk, (VALUES (0), (1), (2)) AS s(k))"""

ORACLE = {
    "conversation_cues": f"""WITH {sql_items(False)},
k AS (
  SELECT conv_id, item AS idx, speaker_key, spoken_text, ({sql_ntok('spoken_text')} * {RATE * 2} / 5)::BIGINT AS frames,
         CASE speaker_key WHEN 'user' THEN {RATE // 2} ELSE {RATE // 4} END AS post
  FROM items WHERE speaker_key IS NOT NULL AND n_lines > 0),
p AS (
  SELECT *, coalesce(sum(frames + post) OVER (PARTITION BY conv_id ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_frame FROM k)
SELECT conv_id, idx, speaker_key, start_frame, start_frame + frames AS end_frame, spoken_text FROM p""",
    "timeline_placement": f"WITH {PLACED} SELECT conv_id, idx, frames, occupied, cursor, start_frame, end_frame FROM placed",
    "composite_summary": f"""WITH {PLACED}
SELECT conv_id, min_start, max_end, cursor_end, n_children, pre_margin, post_margin, frames,
       {sql_round('pre_gap', 6)} AS pre_gap, {sql_round('post_gap', 6)} AS post_gap FROM summary""",
    "boundary_trim": f"""WITH {PLACED},
t AS (
  SELECT *, greatest(0, -min_start) AS trim_start, greatest(0, min_start) AS lead_frames,
         greatest(0, cursor_end - max_end) AS tail_frames, greatest(0, max_end - cursor_end) AS cut FROM summary)
SELECT conv_id, frames, trim_start, greatest(trim_start, frames - cut) AS trim_end, lead_frames, tail_frames,
       greatest(0, least(greatest(trim_start, frames - cut), frames) - least(trim_start, frames)) + lead_frames + tail_frames
         AS final_frames FROM t""",
    "placement_report": f"""WITH {PLACED}
SELECT conv_id, idx, 'places ' || label || ' from ' || printf('%.3f', start_frame / {RATE}.0::DOUBLE) || 's to '
       || printf('%.3f', end_frame / {RATE}.0::DOUBLE) || 's' AS message FROM placed""",
    "frame_rounding": f"""
SELECT l_quantity, count(*) AS n, round_even(l_quantity / 2, 0)::BIGINT AS frames,
       {sql_round('round_even(l_quantity * 0.37::DOUBLE * 48000, 0) / 48000', 6)} AS seconds
FROM lineitem GROUP BY l_quantity""",
    "nested_timeline": f"""WITH {_TREE},
mid_abs AS (
  SELECT m.production, m.node_id, m.frames, cursor + pre AS start_frame, cursor + pre - s.min_start AS abs_start,
         m.min_start FROM mid_cur m JOIN mid_sum s ON m.parent_id = s.node_id)
SELECT production, node_id, frames, start_frame, abs_start FROM mid_abs
UNION ALL
SELECT l.production, l.node_id, l.frames, cursor + pre, a.abs_start + cursor + pre - a.min_start
FROM leaf_cur l JOIN mid_abs a ON l.parent_id = a.node_id""",
    "nested_summary": f"""WITH {_TREE}
SELECT production, node_id, min_start, max_end, cursor_end, n_children, max_end - min_start AS frames FROM leaf_sum
UNION ALL
SELECT production, node_id, min_start, max_end, cursor_end, n_children, max_end - min_start FROM mid_sum""",
    "tree_leaves": """
SELECT n_regionkey::BIGINT AS production, 'c' || c_custkey AS node_id, 2 AS depth
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT n_regionkey::BIGINT, 'n' || n_nationkey, 1 FROM nation
WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
UNION ALL
SELECT r_regionkey::BIGINT, 'r' || r_regionkey, 0 FROM region
WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""",
    "mix_overlap": f"WITH {_MIX} SELECT label, frame, {sql_round('v', 6)} AS value FROM m",
    "mix_with_silence": f"""WITH {_MIX},
len AS (SELECT label, max(start_frame + frames) AS n FROM p GROUP BY label),
g AS (SELECT label, unnest(range(n)) AS frame FROM len)
SELECT g.label, g.frame, {sql_round('coalesce(v, 0.0)', 6)} AS value
FROM g LEFT JOIN m ON g.label = m.label AND g.frame = m.frame""",
    "slice_time": f"""
WITH b AS (
  SELECT vec_id AS idx, embedding, (vec_id % 50) / 100.0::DOUBLE AS s,
         CASE WHEN vec_id % 13 = 0 THEN (vec_id % 50) / 100.0::DOUBLE - 0.05 ELSE (vec_id % 50) / 100.0::DOUBLE + 0.105 END AS t
  FROM embeddings),
f AS (
  SELECT idx, embedding, greatest(0, round_even(s * 100, 0)::BIGINT) AS a, round_even(t * 100, 0)::BIGINT AS z
  FROM b WHERE t >= s),
c AS (SELECT idx, list_slice(embedding, a + 1, greatest(a, z)) AS x FROM f WHERE greatest(a, z) > a)
SELECT idx, generate_subscripts(x, 1)::BIGINT - 1 AS frame, unnest(list_transform(x, lambda v: CASE WHEN round(v::DOUBLE, 6) = 0 THEN 0.0 ELSE round(v::DOUBLE, 6) END)) AS value FROM c""",
    "slice_from": """
WITH c AS (
  SELECT vec_id AS idx, list_slice(embedding, trunc(((vec_id % 70) / 100.0::DOUBLE + 0.006) * 100)::BIGINT + 1, 64) AS x
  FROM embeddings)
SELECT idx, generate_subscripts(x, 1)::BIGINT - 1 AS frame,
       unnest(list_transform(x, lambda v: CASE WHEN round(v::DOUBLE, 6) = 0 THEN 0.0 ELSE round(v::DOUBLE, 6) END)) AS value
FROM c WHERE len(x) > 0""",
    "slice_markers": f"""WITH {_MARK},
x AS (
  SELECT *, CASE WHEN last_frame > first_frame THEN list_slice(samples, first_frame + 1, last_frame) ELSE [] END AS s FROM sl),
y AS (SELECT *, coalesce(list_sum(list_transform(s, lambda v: v::DOUBLE)), 0.0) AS t FROM x)
SELECT idx, slice_no, first_frame, last_frame, len(s)::BIGINT AS frames, {sql_round('t', 5)} AS total FROM y""",
    "splice_order": f"""WITH {_MARK},
u AS (
  SELECT idx AS clip, slice_no * 2 AS idx, last_frame - first_frame AS frames FROM sl
  UNION ALL SELECT vec_id, k * 2 + 1, 10 FROM embeddings, (VALUES (0), (1)) AS v(k))
SELECT clip, idx::BIGINT AS idx, frames::BIGINT AS frames,
       coalesce(sum(frames) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
         AS start_frame FROM u""",
    "clip_durations": f"""
SELECT label::BIGINT AS label, count(*) AS n_clips, sum(len(embedding))::BIGINT AS frames,
       {sql_round('sum(len(embedding)) / 24000.0::DOUBLE', 6)} AS seconds, 0.0::DOUBLE AS unrated_seconds
FROM embeddings GROUP BY label""",
}
