"""Marks, assets, requests, settings, caches and the stream."""

import hashlib
import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuesheet import settings as C
from cuesheet.operators import assets as X
from cuesheet.operators import marks as M
from cuesheet.operators import presets as P
from cuesheet.operators import requests as R
from cuesheet.sources import asr, caches, debug, documents, media
from cuesheet.streaming import intake


def test_marks_bubble_per_level(spark):
    nodes = spark.createDataFrame(
        [("p", "r", None, 0, 0), ("p", "a", "r", 1, 0), ("p", "b", "r", 1, 1)]
        + [("p", f"a{i}", "a", 2, i) for i in range(3)]
        + [("p", f"b{i}", "b", 2, i) for i in range(3)],
        "production string, node_id string, parent_id string, depth int, idx bigint",
    )
    marks = spark.createDataFrame([("p", "a0", "x"), ("p", "a1", "x"), ("p", "b1", "x"), ("p", "b2", "y"), ("p", "a2", "y")], "production string, node_id string, mark string")
    found = M.bubble(nodes, marks, 2)
    shown = {(r.node_id, r.mark): r.child_id for r in found.collect()}
    # x is doubled inside a and so hidden there; the one in b shows above. y shows in both, not above.
    assert shown == {("b", "x"): "b1", ("b", "y"): "b2", ("a", "y"): "a2", ("r", "x"): "b"}
    left = M.cut_tree(nodes, found, spark.createDataFrame([("p", "x")], "production string, mark string"), 2)
    assert sorted(r.node_id for r in left.collect()) == ["b", "b1", "b2", "r"]
    missing = M.cut_errors(found.where("depth = 0"), spark.createDataFrame([("p", "y")], "production string, mark string"), ["production"])
    assert missing.first().message == "Unknown or ambiguous audio mark 'y'"


def test_sounds(spark):
    files = spark.createDataFrame([("foley/door.wav",), ("archive/foley/door.wav",), ("left/bell.wav",), ("right/bell.mp3",), ("a.txt",), (".wav",)], "path string")
    refs = spark.createDataFrame([("foley/door",), ("door.v1",), ("bell",), ("left\\bell.flac",), ("nothing",), ("/s/left/bell.wav",), ("/s/left/bell",), ("Door",)], "ref string")
    got = {r.ref: r for r in X.resolve_sounds(refs, files, "/s").collect()}
    assert got["foley/door"].resolved_path == "/s/foley/door.wav"
    assert got["door.v1"].resolved_path == "/s/foley/door.wav"
    assert "matched multiple files" in got["bell"].error
    assert got["left\\bell.flac"].resolved_path == "/s/left/bell.wav"
    assert "was not found under /s" in got["nothing"].error and "not found" in got["Door"].error
    assert got["/s/left/bell.wav"].resolved_path == "/s/left/bell.wav"
    assert "absolute path" in got["/s/left/bell"].error
    tied = sorted(r.path for r in X.ambiguous_files(refs, files).where("tail = 'bell'").collect())
    assert tied == ["left/bell.wav", "right/bell.mp3"]


def test_voices_and_listings(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-voices-")
    for name in ("Anna.wav", "ben.MP3", "notes.txt", "sub/deep.wav"):
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as handle:
            handle.write("x")
    files = media.voice_files(spark, folder).select("path")
    assert files.count() == 3
    assert {r.path for r in media.sound_files(spark, folder).collect()} == {"Anna.wav", "ben.MP3", "sub/deep.wav"}
    refs = spark.createDataFrame([("anna",), ("BEN",), ("notes.txt",), ("x/Anna.ogg",), ("deep",)], "voice_name string")
    got = {r.voice_name: r.resolved_path for r in X.resolve_voices(refs, files, folder).collect()}
    assert got == {"anna": f"{folder}/Anna.wav", "BEN": f"{folder}/ben.MP3", "notes.txt": f"{folder}/notes.txt", "x/Anna.ogg": f"{folder}/Anna.wav", "deep": None}
    assert "content" not in media.voice_files(spark, folder)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_keys(spark):
    script, voices = "Speaker 1: naïve “q”", ["/v/a.wav", "/v/é.wav"]
    df = spark.createDataFrame([(script, voices)], "s string, v array<string>")
    payload = json.dumps({"normalized_script": script, "voice_samples": voices}, sort_keys=True, ensure_ascii=True)
    assert df.select(R.canonical_key("s", "v")).first()[0] == hashlib.sha256(payload.encode()).hexdigest()
    rows = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y"), ("b", 1, "x"), ("c", 0, "x"), ("c", 1, "y"), ("d", 0, None), ("d", 1, "y")]
    digests = {r.k: r.digest for r in R.digest(spark.createDataFrame(rows, "k string, i int, t string").repartition(5), ["k"], F.col("i"), F.col("t")).collect()}
    assert digests["a"] == digests["c"] and len(set(digests.values())) == 3


def test_cache_round_trip(spark):
    path = tempfile.mkdtemp(prefix="cuesheet-cache-") + "/render"
    assert caches.read_cache(spark, path, caches.RENDER_SCHEMA).count() == 0
    entries = spark.createDataFrame([("k1", 24000, 1200), ("k1", 24000, 1200), ("k2", 24000, 5)], caches.RENDER_SCHEMA)
    caches.append_cache(entries, path, caches.RENDER_SCHEMA)
    caches.append_cache(entries, path, caches.RENDER_SCHEMA)
    cache = caches.read_cache(spark, path, caches.RENDER_SCHEMA)
    assert cache.count() == 2
    asked = spark.createDataFrame([("k1",), ("k3",)], "key string")
    assert {r.key: r.state for r in R.split_by_cache(asked, cache, "cache").collect()} == {"k1": "hit", "k3": "skip"}
    frames = cache.where("key = 'k1'").select(R.replay_frames(F.col("frame_count"), F.col("sample_rate"), F.lit(48000))).first()[0]
    assert frames == 2400
    with pytest.raises(ValueError):
        R.split_by_cache(asked, cache, "other")


def test_batches_and_renderer(spark):
    requests = spark.createDataFrame([(i, i % 3, f"text {i}") for i in range(23)], "request_id bigint, k bigint, text string")
    numbered = R.batches(requests, "request_id", ["request_id"], 10)

    def renderer(frames):
        loaded = {"scale": 2}
        for frame in frames:
            yield pd.DataFrame({"batch_no": frame["batch_no"], "pos": frame["pos"], "frames": frame["text"].str.len() * loaded["scale"]})

    results = R.run_renderer(numbered, renderer, "batch_no bigint, pos bigint, frames bigint")
    zipped = R.zip_results(numbered, results).collect()
    assert len(zipped) == 23 and {r.status for r in zipped} == {"ok"}
    assert sorted({(r.batch_no) for r in zipped}) == [0, 1, 2]


def test_presets(spark):
    catalog = P.catalog(spark)
    assert {r.preset for r in catalog.collect()} == {"master", "narrator", "thoughts", "outdoor1", "outdoor2", "indoor1", "indoor2"}
    assert [r.preset for r in P.preview_names(spark).orderBy("idx").collect()] == ["none", "indoor1", "indoor2", "narrator", "outdoor1", "outdoor2", "thoughts"]


def test_settings(spark):
    rows = [(0, None, None, ["a", "b", "a"]), (44100, 0.0, True, [])]
    df = spark.createDataFrame(rows, "output_sample_rate int, cfg_scale double, disable_prefill boolean, debug_categories array<string>")
    got = [tuple(r) for r in C.resolve(df).collect()]
    assert got == [(48000, 1.2, False, ["a", "b"]), (44100, 0.0, True, [])]


def test_debug_output(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-debug-")
    messages = spark.createDataFrame([("whisperx", "a"), ("compose_audio", "b")], "category string, message string")
    debug.write_debug_lines(debug.debug_lines(messages, ["whisperx"]), folder + "/log")
    assert [r.value for r in spark.read.text(folder + "/log").collect()] == ["[whisperx] a"]
    with pytest.raises(ValueError):
        debug.debug_lines(messages, ["nope"])
    assert debug.unknown_categories(messages).count() == 0


def test_asr_json_files(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-asr-")
    payload = {"language": "en", "segments": [{"text": " Hi there.", "start": 0.031, "end": 1.2, "words": [{"word": "Hi", "start": 0.031, "end": 0.2, "score": 0.9}, {"word": "there."}]}, {"text": "Bye", "end": 2.0}]}
    with open(folder + "/a.json", "w") as handle:
        json.dump(payload, handle, indent=1)
    read = asr.read_asr(spark, folder + "/*.json")
    row = read.select(asr.clauses(F.col("segments")).alias("c"), asr.words(F.col("segments")).alias("w")).first()
    assert [tuple(c) for c in row.c] == [(" Hi there.", 0.031, 1.2), ("Bye", None, 2.0)]
    assert [tuple(w) for w in row.w] == [("Hi", 0.031, 0.2), ("there.", None, None)]


def test_document_files(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-docs-")
    with open(folder + "/one.xml", "w") as handle:
        handle.write("<production>\n<mark id='a'/>\n</production>")
    nodes = documents.shred(documents.read_documents(spark, folder + "/*.xml")).where("kind = 'element'")
    assert [(r.tag, r.line, r.col) for r in nodes.orderBy("node_id").collect()] == [("production", 1, 1), ("mark", 2, 1)]


def test_stream_drops_repeats(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-stream-")
    schema = "key string, request_id bigint, empty boolean, ts timestamp"
    base = spark.createDataFrame([("a", 1, False, 1), ("b", 2, False, 2), ("a", 3, False, 3), ("c", 4, True, 4), ("d", 5, False, 5)], "key string, request_id bigint, empty boolean, s bigint")
    stamped = base.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s")
    stamped.where("request_id <= 2").coalesce(1).write.parquet(folder + "/in/1")
    stamped.where("request_id > 2").coalesce(1).write.parquet(folder + "/in/2")
    caches.append_cache(spark.createDataFrame([("d",)], "key string"), folder + "/cache", "key string")
    source = intake.read_requests(spark, folder + "/in/*", schema)
    intake.intake(source, folder + "/out", folder + "/state", folder + "/cache", "key string").awaitTermination()
    got = {r.key: r.batch_no for r in intake.accepted(spark, folder + "/out").collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] is None and got["a"] == 0


def test_intake_costs_the_same_each_epoch(spark):
    """Many epochs with repeats: each key once, the first of its micro-batch, and no epoch reads what others wrote."""
    folder = tempfile.mkdtemp(prefix="cuesheet-epochs-")
    schema = "key string, request_id bigint, empty boolean"
    epochs = 12
    for k in range(epochs):
        own = [(f"n{k}-{i}", (1 << 61) - 1000 * k - i, i == 3) for i in range(5)]
        again = [(f"n{j}-1", 5, False) for j in range(k)] + [(f"n{k}-0", (1 << 61) - 5000 * k - 77_777, False)]
        spark.createDataFrame(own + again, schema).coalesce(1).write.mode("append").parquet(folder + "/in")
    source = intake.read_requests(spark, folder + "/in", schema)
    query = intake.intake(source, folder + "/out", folder + "/state")
    query.awaitTermination()
    rows = intake.accepted(spark, folder + "/out").collect()
    assert sorted(r.key for r in rows) == sorted(f"n{k}-{i}" for k in range(epochs) for i in range(5))
    assert {r.epoch for r in rows} == set(range(epochs))
    assert all(r.request_id == (1 << 61) - 5000 * int(r.key[1:-2]) - 77_777 for r in rows if r.key.endswith("-0"))
    assert all((r.batch_no is None) == r.key.endswith("-3") for r in rows)
    # A micro-batch reads its own rows; the state grows by its new keys.
    progress = query.recentProgress
    assert [p.numInputRows for p in progress if p.numInputRows] == [6 + k for k in range(epochs)]
    assert [p.stateOperators[0].numRowsTotal for p in progress][-1] == 5 * epochs
    again = intake.intake(source, folder + "/out", folder + "/state")
    again.awaitTermination()
    assert intake.accepted(spark, folder + "/out").count() == len(rows)


def test_listing_in_any_form_of_a_folder(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-listing-")
    os.makedirs(folder + "/sub")
    for name in ("a.wav", "sub/b.wav"):
        with open(f"{folder}/{name}", "w") as handle:
            handle.write("x")
    for form in (folder, folder + "/", f"file://{folder}", f"file:{folder}"):
        assert {r.path for r in media.sound_files(spark, form).collect()} == {"a.wav", "sub/b.wav"}
        assert [r.path for r in media.voice_files(spark, form).collect()] == [f"{folder}/a.wav"]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from cuesheet.session import shared_folder

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda name, default: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    with pytest.raises(ValueError):
        shared_folder(session("yarn"))
    with pytest.raises(ValueError):
        shared_folder(session("local-cluster[2,1,1024]"))
    assert shared_folder(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_folder(session("local[2]"))


def test_batches_in_any_order(spark):
    rows = [(f"d{k % 7}", k) for k in range(137)]
    got = R.ranked_batches(spark.createDataFrame(rows, "doc string, script int"), ["doc", "script"], 10).collect()
    expected = {(*key, n // 10, n % 10) for n, key in enumerate(sorted(rows))}
    assert {tuple(r) for r in got} == expected
