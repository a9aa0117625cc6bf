"""Whole jobs: planning a corpus, and taking requests in as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as T
from cuesheet.operators import timeline
from cuesheet.plans import production
from cuesheet.registry.common import LB, sql_ntok, sql_strip, table
from cuesheet.registry.documents import KINDS, production_documents
from cuesheet.session import work_path
from cuesheet.streaming import intake

RATE = 1000
FILES = 8  # of a wave of requests, read by one micro-batch


def _plan(spark, sf_dir):
    """The corpus of documents with the two voices its maps name."""
    voice = F.when(F.col("role") == "user", "a").when(F.col("role") == "assistant", "b").otherwise("s")
    files = table(spark, sf_dir, "conversations").select(F.concat(F.lit("/voices/"), voice, F.lit(".wav")).alias("path"))
    return production.plan(production_documents(spark, sf_dir), files.distinct(), "/voices")


def plan_requests(spark, sf_dir):
    return _plan(spark, sf_dir).requests.select(
        "doc_id", "script_id", "block_no", "tts", "normalized_script", F.array_join("voice_samples", ",").alias("voices")
    )


def plan_errors(spark, sf_dir):
    found = _plan(spark, sf_dir).errors
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_errors"))


def plan_timeline(spark, sf_dir):
    planned = _plan(spark, sf_dir)
    spoken = planned.contents.where("kind = 'line'").groupBy("doc_id", F.col("script_id").alias("node_id")).agg(
        (F.sum(T.token_count(F.col("spoken_text"))) * 100).alias("frames")
    )
    _, trimmed = production.timeline(planned, spoken, RATE)
    return trimmed.select(F.col("production").alias("doc_id"), "final_frames", "lead_frames", "tail_frames")


def missing_clips(spark, sf_dir):
    """Every third document's scripts were not rendered: they are named, and nothing is placed at length 0."""
    planned = _plan(spark, sf_dir)
    spoken = planned.contents.where("kind = 'line' AND doc_id % 3 <> 0")
    clips = spoken.select("doc_id", F.col("script_id").alias("node_id"), F.lit(100).cast("bigint").alias("frames")).distinct()
    return production.missing_clips(planned, clips).select("doc_id", "node_id")


def empty_productions(spark, sf_dir):
    """Customers as productions, their orders as clips: one without orders has an empty result."""
    none = F.lit(None).cast("double")
    root = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("production"), F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("idx"), F.lit(True).alias("is_container"),
        F.lit(0).cast("bigint").alias("frames"), F.lit(0.0).alias("pre_gap"), F.lit(0.0).alias("post_gap"), none.alias("length"),
    )
    clips = table(spark, sf_dir, "orders").where("o_custkey % 7 <> 3").select(
        F.col("o_custkey").alias("production"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"),
        F.lit("root").alias("parent_id"), F.lit(1).alias("depth"), F.col("o_orderkey").alias("idx"),
        F.lit(False).alias("is_container"), (F.col("o_orderkey") % 100 + 1).alias("frames"),
        F.lit(0.0).alias("pre_gap"), F.lit(0.5).alias("post_gap"), none.alias("length"),
    )
    _, summaries = timeline.compose_tree(root.unionByName(clips), 4, 1)
    return summaries.select("production", "n_children", "frames", "cursor_end")


def intake_late(spark, sf_dir):
    """Requests in several files, the later files with earlier turns and many repeats: each key is taken in once."""
    turns = table(spark, sf_dir, "conversations").select(
        F.sha2("text", 256).alias("key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        (T.token_count(F.col("text")) == 0).alias("empty"), F.pmod("conv_id", F.lit(3)).alias("wave"),
    )
    target = work_path(spark, "intake-late")
    for wave in (2, 1, 0):
        # A third of what came before comes again.
        again = turns.where((F.col("wave") > wave) & (F.col("request_id") % 3 == 0))
        rows = turns.where(F.col("wave") == wave).unionByName(again).drop("wave")
        rows.repartition(FILES).write.mode("append").parquet(f"{target}/in")
    source = intake.read_requests(spark, f"{target}/in", "key string, request_id bigint, empty boolean", FILES)
    intake.intake(source, f"{target}/rows", f"{target}/state").awaitTermination()
    taken = intake.accepted(spark, f"{target}/rows")
    return taken.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("batch_no").isNull()).alias("settled"))


def request_intake(spark, sf_dir):
    """Conversation turns as a stream of requests; equal texts are taken in once."""
    path = f"{sf_dir.rstrip('/')}/conversation[s].parquet"
    source = intake.read_requests(spark, path, "conv_id bigint, turn bigint, role string, text string")
    requests = source.select(
        "conv_id", "turn", F.sha2("text", 256).alias("key"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        (T.token_count(F.col("text")) == 0).alias("empty"),
    )
    target = work_path(spark, "intake")
    query = intake.intake(requests, f"{target}/rows", f"{target}/state")
    query.awaitTermination()
    return intake.accepted(spark, f"{target}/rows").select("key", F.col("batch_no").isNull().alias("settled"))


QUERIES = {
    "plan_requests": plan_requests,
    "plan_errors": plan_errors,
    "plan_timeline": plan_timeline,
    "request_intake": request_intake,
    "intake_late": intake_late,
    "missing_clips": missing_clips,
    "empty_productions": empty_productions,
}

_SOUND = f"""
d AS (SELECT *, conv_id * 1000 + turn AS doc_id, (conv_id * 7 + turn) % {KINDS} AS kind FROM conversations),
x AS (
  SELECT doc_id, kind, role, list_filter(list_transform(regexp_split_to_array(text, {LB}),
      lambda x: {sql_strip('x')}), lambda x: x <> '') AS l
  FROM d WHERE (kind = 0 OR kind > 15) AND role IN ('user', 'assistant')),
t AS (SELECT *, array_to_string(l, ' ') AS spoken FROM x)"""

ORACLE = {
    "plan_requests": f"""WITH {_SOUND}
SELECT doc_id, 3 AS script_id, 0::BIGINT AS block_no, CASE kind WHEN 0 THEN 'qwen' ELSE 'vibevoice' END AS tts,
       replace('Speaker 1: ' || spoken, '’', '''') AS normalized_script,
       CASE role WHEN 'user' THEN '/voices/a.wav' ELSE '/voices/b.wav' END AS voices
FROM t WHERE len(l) > 0""",
    "plan_errors": f"""
WITH d AS (SELECT *, conv_id * 1000 + turn AS doc_id, (conv_id * 7 + turn) % {KINDS} AS kind FROM conversations),
n AS (
  SELECT doc_id, CASE WHEN kind BETWEEN 1 AND 15 THEN 1 ELSE 0 END
         + CASE WHEN role NOT IN ('user', 'assistant') OR kind = 5 THEN 1 ELSE 0 END AS n FROM d)
SELECT doc_id, n::BIGINT AS n_errors FROM n WHERE n > 0""",
    "plan_timeline": f"""WITH {_SOUND},
f AS (SELECT doc_id, kind, {sql_ntok('spoken')} * 100 AS f FROM t)
SELECT doc_id, CASE kind WHEN 0 THEN greatest(0, 250 + f - 10500) ELSE f END AS final_frames,
       0::BIGINT AS lead_frames, 0::BIGINT AS tail_frames FROM f""",
    "intake_late": f"SELECT DISTINCT sha256(text) AS key, 1::BIGINT AS n, {sql_ntok('text')} = 0 AS settled FROM conversations",
    "missing_clips": f"""WITH {_SOUND}
SELECT doc_id, 3 AS node_id FROM t WHERE len(l) > 0 AND doc_id % 3 = 0""",
    "empty_productions": """
SELECT c_custkey AS production, count(o_orderkey) AS n_children,
       coalesce(sum(o_orderkey % 100 + 3) - 2, 0)::BIGINT AS frames, coalesce(sum(o_orderkey % 100 + 3), 0)::BIGINT AS cursor_end
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_custkey % 7 <> 3 GROUP BY c_custkey""",
    "request_intake": f"SELECT DISTINCT sha256(text) AS key, {sql_ntok('text')} = 0 AS settled FROM conversations",
}
