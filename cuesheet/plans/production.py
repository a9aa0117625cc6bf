"""From a corpus of documents to requests, timelines and audio.

Each stage's table is stored in the shared folder: later stages scan it several times, with few
columns, and a lost executor only repeats a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cuesheet.operators import alignment as A
from cuesheet.operators import assets as X
from cuesheet.operators import blocks as B
from cuesheet.operators import dialogue as D
from cuesheet.operators import marks as M
from cuesheet.operators import mixdown as MX
from cuesheet.operators import presets as P
from cuesheet.operators import requests as R
from cuesheet.operators import timeline as L
from cuesheet.operators import validation as V
from cuesheet.operators.scans import attach, salt
from cuesheet.session import stored
from cuesheet.sources import documents as S

SCRIPT = ["doc_id", "script_id"]


@dataclass(frozen=True)
class Plan:
    """Tables of a planned corpus; ``plan_nodes``, ``contents`` and ``requests`` hold sound documents only."""

    nodes: DataFrame
    errors: DataFrame
    speakers: DataFrame
    plan_nodes: DataFrame
    contents: DataFrame
    requests: DataFrame
    sounds: DataFrame | None = None


def script_parts(nodes: DataFrame, speakers: DataFrame) -> DataFrame:
    """Children of scripts as parts: text runs and inline elements, with the document's speakers.

    All rows of a document stem from one input row, so keys per document stay small.
    """
    known = speakers.groupBy("doc_id").agg(F.collect_set("speaker_key").alias("speakers"))
    children = nodes.where((F.col("parent_tag") == "script") & (F.col("kind") != "error")).select(
        "doc_id",
        F.col("parent_id").alias("script_id"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.when(F.col("kind") == "text", "text").otherwise("audio").alias("kind"),
        "text",
        F.when(F.col("kind") == "element", F.concat(F.lit("<"), "tag", F.lit(">"))).alias("label"),
    )
    empty = F.expr("cast(array() as array<string>)")
    return children.join(known, "doc_id", "left").withColumn("speakers", F.coalesce("speakers", empty))


def plan(
    documents: DataFrame,
    voice_files: DataFrame,
    voice_directory: str,
    sound_files: DataFrame | None = None,
    sounds_root: str = "./sounds",
) -> Plan:
    """Shred, check and plan documents (doc_id, source, xml).

    ``sound_files`` are paths relative to ``sounds_root``; without them sounds are not looked up.
    """
    nodes = stored(S.shred(documents), "nodes")
    entries = stored(S.speaker_entries(nodes), "entries")
    speakers = S.speakers(entries)
    resolved = X.resolve_voices(speakers, voice_files, voice_directory)
    # One voice may be named by every document.
    voiced = stored(X.voices_of(speakers, resolved, salt("doc_id", "speaker_key")), "speakers")
    parts = script_parts(nodes, voiced)
    folded = stored(D.items(D.dialogue_lines(parts, SCRIPT), SCRIPT), "items")
    stray = D.stray_text(folded).select(
        "doc_id", F.col("script_id").alias("node_id"),
        F.lit("Scripts may begin only with a recognized `speaker:` stanza").alias("message"),
    )
    unvoiced = voiced.where("resolved_path is null").select(
        "doc_id", "node_id",
        F.concat(F.lit("Voice '"), "voice_name", F.lit("' for speaker '"), "authored_name", F.lit(f"' was not found in {voice_directory}")).alias("message"),
    )
    all_nodes = V.plan_nodes(nodes)
    sounds, silent = None, unvoiced.limit(0)
    if sound_files is not None:
        sounds = stored(find_sounds(all_nodes, sound_files, sounds_root), "sounds")
        silent = sounds.where("error is not null").select("doc_id", "node_id", F.col("error").alias("message"))
    speaking = S.speaker_errors(entries).select("doc_id", "node_id", "message")
    later = stored(silent.unionByName(speaking).unionByName(unvoiced).unionByName(stray), "late-errors")
    rules = V.errors(nodes).select("doc_id", "node_id", F.col("formatted").alias("message"))
    errors = stored(rules.unionByName(V.located(later, nodes)), "errors")
    # A document with any error yields nothing further; that is settled before anything costly.
    broken = errors.select("doc_id").distinct()
    plan_nodes = all_nodes.join(broken, "doc_id", "left_anti")
    contents = stored(D.contents(folded, SCRIPT).join(broken, "doc_id", "left_anti"), "contents")
    return Plan(nodes, errors, voiced, plan_nodes, contents, requests(contents, voiced, plan_nodes), sounds)


def find_sounds(plan_nodes: DataFrame, sound_files: DataFrame, root: str) -> DataFrame:
    """Resolved file or error of every sound element: (doc_id, node_id, ref, resolved_path, error)."""
    uses = plan_nodes.where("tag = 'sound' and value is not null").select("doc_id", "node_id", F.col("value").alias("ref"))
    found = X.resolve_sounds(uses, sound_files, root).select("ref", "resolved_path", "error")
    # One sound may be used a third of the time.
    return attach(uses, found, ["ref"], salt("doc_id", "node_id"))


def _marks(plan_nodes: DataFrame) -> DataFrame:
    return plan_nodes.where("tag = 'mark'").select(
        F.col("doc_id").alias("production"), F.col("node_id").cast("string").alias("node_id"), F.col("value").alias("mark")
    )


def _cut(tree: DataFrame, marks: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    shape = tree.select("production", "node_id", "parent_id", "depth", "idx")
    bubbled = stored(M.bubble(shape, marks, max_depth), "bubbled")
    wanted = targets.select(F.col("doc_id").alias("production"), "mark")
    return M.cut_tree(tree, bubbled, wanted, max_depth)


def cut_problems(plan_: Plan, targets: DataFrame) -> DataFrame:
    """Cut marks (doc_id, mark) their production does not show."""
    shape = _shape(plan_.plan_nodes)
    bubbled = M.bubble(shape, _marks(plan_.plan_nodes), _deepest(shape)).where("depth = 0")
    wanted = targets.select(F.col("doc_id").alias("production"), "mark")
    return M.cut_errors(bubbled, wanted, ["production"]).withColumnRenamed("production", "doc_id")


def cut_requests(plan_: Plan, targets: DataFrame) -> DataFrame:
    """Requests still needed after cutting each production before its mark, to be taken before rendering."""
    shape = stored(_shape(plan_.plan_nodes), "shape")
    left = _cut(shape, _marks(plan_.plan_nodes), targets, _deepest(shape))
    scripts = left.select(F.col("production").alias("doc_id"), F.col("node_id").cast("int").alias("script_id"))
    return M.surviving_requests(plan_.requests, scripts, SCRIPT)


def _shape(plan_nodes: DataFrame) -> DataFrame:
    return plan_nodes.select(
        F.col("doc_id").alias("production"), F.col("node_id").cast("string").alias("node_id"),
        F.col("parent_id").cast("string").alias("parent_id"), "depth", F.col("ordinal").cast("bigint").alias("idx"),
    )


def _deepest(tree: DataFrame) -> int:
    """Depth of the deepest document, one number."""
    return max(tree.agg(F.max("depth")).first()[0] or 0, 1)


def requests(contents: DataFrame, speakers: DataFrame, plan_nodes: DataFrame) -> DataFrame:
    """One request per script with lines: normalised text and voice files in speaker order, and one key.

    The key is a digest of the numbered lines and the voices, so it is the script's however long that is. Its text comes
    in blocks of bounded size, the rows of one request; joined by newlines they are the script.
    """
    lines = stored(D.normalized_lines(contents, SCRIPT), "lines")
    blocks = D.script_blocks(lines, SCRIPT)
    digests = R.digest(lines, SCRIPT, F.col("line_no"), F.col("line")).select(*SCRIPT, "digest")
    paths = speakers.groupBy("doc_id", "speaker_key").agg(F.min("resolved_path").alias("path"))
    voices = (
        D.speakers(contents, SCRIPT)
        .join(paths, ["doc_id", "speaker_key"])
        .groupBy(*SCRIPT)
        .agg(F.array_sort(F.collect_list(F.struct("speaker_no", "path"))).alias("v"))
        .select(*SCRIPT, F.transform("v", lambda v: v["path"]).alias("voice_samples"))
    )
    backends = plan_nodes.where("tag = 'script'").select("doc_id", F.col("node_id").alias("script_id"), "tts")
    joined = blocks.join(voices.join(digests, SCRIPT), SCRIPT).join(backends, SCRIPT)
    key = F.sha2(F.to_json(F.struct("digest", "voice_samples")), 256)
    return joined.select(*SCRIPT, "block_no", "tts", "normalized_script", "voice_samples", key.alias("key"))


def render(
    requests_: DataFrame, cache: DataFrame, renderer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Run a renderer on what the cache lacks, in batches of requests numbered by document and script.

    Equal requests are rendered once, by the first of them; all blocks of a request go to the same batch.
    """
    todo = R.cache_misses(requests_, cache)
    owner = todo.groupBy("key").agg(F.min(F.struct(*SCRIPT)).alias("_first"))
    firsts = owner.select("key", F.col("_first.doc_id").alias("doc_id"), F.col("_first.script_id").alias("script_id"))
    numbered = R.ranked_batches(firsts, SCRIPT)
    return R.run_renderer(todo.join(numbered, [*SCRIPT, "key"]), renderer, schema)


def missing_clips(plan_: Plan, clip_frames: DataFrame) -> DataFrame:
    """Scripts with lines and sounds that have no rendered clip: (doc_id, node_id, message).

    ``timeline`` leaves their productions out: a clip of unknown length cannot be placed, nor what follows it.
    """
    spoken = plan_.contents.where("kind = 'line'").select("doc_id", F.col("script_id").alias("node_id"))
    sounds = plan_.plan_nodes.where("tag = 'sound'").select("doc_id", "node_id")
    needed = spoken.unionByName(sounds).distinct()
    found = clip_frames.where("frames is not null").select("doc_id", "node_id")
    return needed.join(found, ["doc_id", "node_id"], "left_anti").withColumn(
        "message", F.lit("No rendered clip: its length is unknown")
    )


def script_arrays(contents: DataFrame) -> DataFrame:
    """Each script as one row: its spoken lines and, per inline item, how many lines stand before it.

    The rows of a script come from one document, which was one cell to begin with.
    """
    item = F.struct("content_idx", "kind", "spoken_text")
    gathered = contents.groupBy(*SCRIPT).agg(F.array_sort(F.collect_list(item)).alias("items"))
    is_audio = lambda x: x["kind"] == "audio"
    return gathered.select(
        *SCRIPT,
        F.transform(F.filter("items", lambda x: ~is_audio(x)), lambda x: x["spoken_text"]).alias("lines"),
        # The n-th inline item at place i has i - n lines before it.
        F.transform(F.filter("items", is_audio), lambda x, n: (x["content_idx"] - n).cast("int")).alias("lines_before"),
    )


def script_markers(contents: DataFrame, clip_frames: DataFrame, rate: int, asr: DataFrame | None = None) -> DataFrame:
    """Marker frames of scripts with inline items: (doc_id, node_id, markers).

    ``asr``: doc_id, script_id, coarse, fine, words as the alignment operators take them. Without it,
    and for scripts it lacks, time is shared by token count.
    """
    clip = clip_frames.withColumnRenamed("node_id", "script_id")
    scripts = script_arrays(contents).where(F.size("lines_before") > 0).join(clip, SCRIPT)
    guessed = scripts.withColumn(
        "guess", A.fallback_clauses(F.col("lines"), F.col("frames").cast("double") / rate)
    )
    if asr is None:
        aligned = guessed.withColumn("clauses", F.col("guess")).withColumn("words", A.fallback_words(F.col("guess")))
    else:
        decided = A.decide(guessed.join(asr, SCRIPT, "left"))
        lost = F.col("decision") == "fallback"
        aligned = decided.withColumn("clauses", F.when(lost, F.col("guess")).otherwise(F.col("clauses"))).withColumn(
            "words", F.when(lost, A.fallback_words(F.col("guess"))).otherwise(F.col("words"))
        )
    filled = A.line_spans(aligned).withColumn("filled", A.fill_gaps(F.col("spans")))
    positions = A.inline_positions(F.col("filled"), F.col("lines_before"))
    return filled.select(
        "doc_id", F.col("script_id").alias("node_id"), A.marker_frames(positions, F.col("frames"), rate).alias("markers")
    )


def plan_tree(plan_nodes: DataFrame, clip_frames: DataFrame, markers: DataFrame) -> DataFrame:
    """Plan tree with string node ids; scripts with inline items become slices and items in turn."""
    as_text = lambda df: df.withColumn("node_id", F.col("node_id").cast("string"))
    ids = as_text(plan_nodes).withColumn("parent_id", F.col("parent_id").cast("string"))
    has_children = (
        ids.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
    ).withColumn("_c", F.lit(True))
    parents = ids.select("doc_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("_parent_tag"))
    # Children of one script stem from one document, so this window is small.
    siblings = Window.partitionBy("doc_id", "parent_id").orderBy("ordinal")
    own = (
        ids.join(has_children, ["doc_id", "node_id"], "left")
        .join(as_text(clip_frames), ["doc_id", "node_id"], "left")
        .join(parents, ["doc_id", "parent_id"], "left")
        .select(
            F.col("doc_id").alias("production"), "node_id", "parent_id", "depth",
            F.when(F.col("_parent_tag") == "script", F.row_number().over(siblings) * 2 - 1)
            .otherwise(F.col("ordinal")).cast("bigint").alias("idx"),
            (F.coalesce("_c", F.lit(False)) | (F.col("depth") == 0)).alias("is_container"),
            F.coalesce("frames", F.lit(0)).cast("bigint").alias("frames"),
            "pre_gap", "post_gap",
            # A preset wraps its script and states no length of its own.
            F.when(F.col("preset").isNull(), F.col("length")).alias("length"),
            F.when(~P.no_preset(F.col("preset")), P.canonical(F.col("preset"))).alias("preset"),
            F.col("node_id").alias("source"), F.lit(0).cast("bigint").alias("first"),
        )
    )
    spans = F.transform(
        F.sequence(F.lit(0), F.size("markers") - 2),
        lambda k: F.struct(
            k.alias("k"),
            F.get("markers", k).cast("bigint").alias("first"),
            F.greatest(F.get("markers", k + 1) - F.get("markers", k), F.lit(0)).alias("frames"),
        ),
    )
    slices = (
        as_text(markers).join(ids.select("doc_id", "node_id", "depth"), ["doc_id", "node_id"])
        .select("doc_id", "node_id", "depth", F.explode(spans).alias("s"))
        .select(
            F.col("doc_id").alias("production"),
            F.concat_ws("/", "node_id", F.col("s.k").cast("string")).alias("node_id"),
            F.col("node_id").alias("parent_id"),
            (F.col("depth") + 1).alias("depth"),
            (F.col("s.k") * 2).cast("bigint").alias("idx"),
            F.lit(False).alias("is_container"),
            F.col("s.frames").cast("bigint").alias("frames"),
            F.lit(0.0).alias("pre_gap"), F.lit(0.0).alias("post_gap"), F.lit(None).cast("double").alias("length"),
            F.lit(None).cast("string").alias("preset"), F.col("node_id").alias("source"), F.col("s.first").alias("first"),
        )
    )
    return own.unionByName(slices)


def timeline(
    plan_: Plan,
    clip_frames: DataFrame,
    rate: int,
    asr: DataFrame | None = None,
    cut_before: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Place the scripts, slices, sounds and marks of every production.

    ``clip_frames``: doc_id, node_id, frames of rendered scripts and sounds. ``cut_before``: doc_id and
    the mark before which all is dropped. Returns (placements, trimmed productions). Only the depth of
    the deepest document comes to the driver.
    """
    placements, summaries, _ = _composed(plan_, clip_frames, rate, asr, cut_before)
    return placements, L.trim_to_boundary(summaries.where("depth = 0"), rate)


def _composed(
    plan_: Plan, clip_frames: DataFrame, rate: int, asr: DataFrame | None, cut_before: DataFrame | None
) -> tuple[DataFrame, DataFrame, int]:
    """(placements, summaries, depth of the deepest document)."""
    missing = stored(missing_clips(plan_, clip_frames), "missing").select("doc_id").distinct()
    whole = plan_.plan_nodes.join(missing, "doc_id", "left_anti")
    markers = script_markers(plan_.contents.join(missing, "doc_id", "left_anti"), clip_frames, rate, asr)
    tree = stored(plan_tree(whole, clip_frames, markers), "tree")
    deepest = _deepest(tree)
    if cut_before is not None:
        tree = stored(_cut(tree, _marks(plan_.plan_nodes), cut_before, deepest), "cut")
    placements, summaries = L.compose_tree(tree, rate, deepest)
    return placements, summaries, deepest


def audio(
    plan_: Plan,
    clips: DataFrame,
    rate: int,
    block_frames: int,
    asr: DataFrame | None = None,
    cut_before: DataFrame | None = None,
    master: str | None = None,
) -> DataFrame:
    """The finished audio of every production as stereo blocks: (clip_id, block_no, start_frame, total, l, r).

    ``clips``: rendered scripts and sounds as blocks of ``block_frames`` at ``rate`` (doc_id, node_id, block_no, start_frame,
    total, l, r). A script's preset is run on the script's whole mix, inline items included, while its place and gaps
    stay as they are; ``master`` is a preset for the whole. Productions that lack a clip are left out, and named by
    ``missing_clips``; presets leave out clips too short for their filters (``blocks.preset_problems``). ``clip_id`` is
    the document, so ``wav.write_wavs`` takes the blocks as they are, with the path added.
    """
    clip_frames = clips.groupBy("doc_id", "node_id").agg(F.max("total").cast("bigint").alias("frames"))
    placements, summaries, deepest = _composed(plan_, stored(clip_frames, "clip-frames"), rate, asr, cut_before)
    of = lambda doc, node: F.to_json(F.struct(F.col(doc).alias("doc"), F.col(node).cast("string").alias("node")))
    sources = clips.select(of("doc_id", "node_id").alias("clip_id"), "block_no", "start_frame", "total", "l", "r")
    placed = placements.withColumn("clip_id", of("production", "source"))
    used = [row[0] for row in placed.where("preset is not null").select("preset").distinct().collect()]  # a catalog name
    done = MX.mix_tree(
        placed,
        stored(L.trim_to_boundary(summaries.where("depth = 0"), rate), "trimmed"),
        sources,
        lambda named: B.by_preset(named, rate, block_frames, used=used),
        deepest,
        block_frames,
    )
    return done if master is None else B.apply_preset(stored(done, "mixed"), master, rate, block_frames)


def preset_of(plan_nodes: DataFrame) -> DataFrame:
    """Canonical preset of every script that names one."""
    return plan_nodes.where("preset is not null").select("doc_id", "node_id", P.canonical(F.col("preset")).alias("preset"))
