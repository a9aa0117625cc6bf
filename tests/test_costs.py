"""What queries must not do again: read twice, split anew, leave the engine, or make a frame for each small row."""

import hashlib
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cuesheet.operators import alignment as A
from cuesheet.operators import blocks as B
from cuesheet.operators import requests as R
from cuesheet.operators import script_rows as SR
from cuesheet.operators import script_search as SS
from cuesheet.operators.scans import Running, chunk_of, running
from cuesheet.registry import requests as requests_registry
from cuesheet.registry import scripts
from cuesheet.sources import documents as S
from cuesheet.sources import wav
from cuesheet.streaming import intake


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_speaker_maps_are_parsed_once(spark):
    """F5"""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    maps = [(i, 1, "element", "speaker-map", text) for i, text in enumerate(["a: 1", "A: x\na: y", "b: z", "{}"])]
    nodes = spark.createDataFrame(maps, "doc_id bigint, node_id int, kind string, tag string, text string")
    entries = S.speaker_entries(nodes)
    errors = S.speaker_errors(entries.mapInPandas(counted, entries.schema)).collect()
    assert sorted((e.doc_id, e.rule) for e in errors) == [(0, "speaker-map entry"), (1, "speaker twice"), (3, "speaker-map entry")]
    assert seen.value == 5


def test_cached_positions_split_no_text_again(spark, sf_dir):
    """F8"""
    for df in requests_registry._position_cache(spark, sf_dir):
        assert "split(" not in _plan(df)


def test_scripts_keep_only_the_arrays_asked_for(spark, sf_dir):
    """F7, F9"""
    found, lines, coarse = scripts._scripts(spark, sf_dir, "coarse")
    assert (found.columns, lines.columns, coarse.columns) == (
        ["doc_id", "lines", "coarse"], ["doc_id", "line_no", "text"], ["doc_id", "idx", "text", "start", "end"]
    )


def test_small_blocks_share_a_frame():
    """F12"""
    samples = np.arange(60, dtype=np.float32) / 64
    content = wav.header(2, 8000, 30, True) + samples.tobytes()
    files = pd.DataFrame({"path": ["a", "b", "c"], "content": [content] * 3})
    frames = list(wav._file_blocks(iter([files]), 7))
    assert len(frames) == 1 and len(frames[0]) == 15
    again = np.concatenate(frames[0][frames[0]["clip_id"] == "b"].sort_values("start_frame")["l"].to_list())
    assert (again == samples[0::2]).all()


def test_canonical_keys_need_no_python(spark):
    """F18"""
    odd = ["", "plain", 'q"\\', "\\u0041", "é😀\n\r\t\b\f\x00\x1f\x7f/end", "😀😀", "a😀b\nc", None, "  <&>'"]
    voices = [["é.wav", None], [], ["a", 'b"'], [""], ["😀"], ["x"], ["y", "z"], ["n"], ["\n"]]
    df = spark.createDataFrame(list(zip(range(9), odd, voices)), "i int, s string, v array<string>")
    keyed = df.select("i", R.canonical_key(F.col("s"), F.col("v")).alias("key"))
    assert "python" not in _plan(keyed).lower()
    dumped = lambda s, v: json.dumps({"normalized_script": s, "voice_samples": v}, sort_keys=True, ensure_ascii=True)
    want = {i: hashlib.sha256(dumped(odd[i], voices[i]).encode()).hexdigest() for i in range(9)}
    assert {r.i: r.key for r in keyed.collect()} == want


class _State:
    exists = False

    def update(self, value):
        self.exists = True


def test_first_request_of_a_key():
    """F6"""
    frame = lambda *ids: pd.DataFrame({"key": ["k"] * len(ids), "request_id": ids})
    state = _State()
    got = [f["request_id"].to_list() for f in intake._new(("k",), iter([frame(7, 5), frame(6), frame(3, 9)]), state)]
    assert got == [[3]] and state.exists
    assert list(intake._new(("k",), iter([frame(1)]), state)) == []


def test_only_unsettled_scripts_are_searched(spark, monkeypatch):
    """F2, F3, F4"""
    clause = "array<struct<text: string, start: double, end: double>>"
    one = lambda *texts: [(t, i / 2, i / 2 + 0.5) for i, t in enumerate(texts)]
    scripts_ = [("sure", ["a b", "c"], one("a b", "c"), one("a", "b", "c"), one("a", "b", "c")),
                ("words", ["a b", "c"], one("a", "b c"), one("a", "b c"), one("x", "a", "b", "c"))]
    df = spark.createDataFrame(scripts_, f"s string, lines array<string>, coarse {clause}, fine {clause}, words {clause}")
    rows = lambda array, pos: A.unfold(df, ["s"], F.col(array), pos, "_c").select("s", pos, "_c.*")
    lines = A.unfold(df, ["s"], F.col("lines"), "line_no", "text")
    marked = df.select("s", F.lit(True).alias("has_coarse"))
    search, seen = SS.greedy_hits, []

    def watched(some, tokens, keys):
        seen.append({r.s for r in some.unionByName(tokens, allowMissingColumns=True).select("s").collect()})
        return search(some, tokens, keys)

    monkeypatch.setattr(SS, "greedy_hits", watched)
    got = SR.aligned_spans(marked, lines, rows("coarse", "idx"), rows("fine", "idx"), rows("words", "pos"), ["s"])
    spans = {(r.s, r.line_no): (r.start, r.end) for r in got.collect()}
    assert seen == [{"words"}]
    assert spans == {("sure", 0): (0.0, 0.5), ("sure", 1): (0.5, 1.0), ("words", 0): (0.0, 1.5), ("words", 1): (1.5, 2.0)}


def test_pieces_are_summed_without_a_python_object_each(spark, monkeypatch):
    """F16"""
    piece = lambda key, no, at, *x: {"key": key, "block_no": no, "salt": 0, "at": at, "l": list(x), "r": [-v for v in x]}
    rows = [piece("a", 1, 2, 1.0, 2.0), piece(None, 1, 0, 8.0), piece("a", 1, 5, 4.0), piece("a", 0, 7, 3.0), piece("a", 1, 3, 0.5)]
    schema = pa.schema([("key", pa.string()), ("block_no", pa.int64()), ("salt", pa.int32()), ("at", pa.int32()),
                        ("l", pa.list_(pa.float64())), ("r", pa.list_(pa.float64()))])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    want = [piece("a", 1, 2, 1.0, 2.5, 0.0, 4.0), piece(None, 1, 0, 8.0), piece("a", 0, 7, 3.0)]
    for limit, parts in ((4, 2), (1, 3), (100, 1)):
        monkeypatch.setattr(B, "SUM_FRAMES", limit)
        made = list(B._block_sums(batch, ["key", "block_no", "salt"], ["l", "r"], 8, False))
        assert len(made) == parts and [row for part in made for row in part.to_pylist()] == want
    whole = [row for part in B._block_sums(batch, ["key", "block_no"], ["l", "r"], 8, True) for row in part.to_pylist()]
    assert [row["l"] for row in whole] == [[0, 0, 1.0, 2.5, 0, 4.0, 0, 0], [8.0, *[0] * 7], [*[0] * 7, 3.0]]
    blocks = spark.range(1).selectExpr("id AS clip_id", "0L AS block_no", "0L AS start_frame", "1L AS total", "array(1f) AS l", "array(2f) AS r")
    mixed = B.mix_blocks(blocks, ["clip_id"], 8, channels=("l", "r"))
    assert "MapInPandas" not in _plan(mixed) + _plan(B.run_stage(blocks, B.mid_side(1.0, 1.0), 8))


def test_settled_scripts_make_no_later_stage(spark):
    """F10, F11, F13"""
    clause = "array<struct<text: string, start: double, end: double>>"
    one = lambda *texts: [(t, i / 2, i / 2 + 0.5) for i, t in enumerate(texts)]
    rows = [("sure", ["a b", "c"], one("a b", "c"), one("a", "b", "c"), one("a", "b", "c")),
            ("split", ["a b", "c"], one("a", "b c"), one("a", "b", "c"), one("a", "b", "c")),
            ("words", ["a b", "c"], one("a", "b c"), one("a", "b c"), one("x", "a", "b", "c")),
            ("lost", ["a b", "c"], None, one("a b", "c"), one("a", "b", "c"))]
    df = spark.createDataFrame(rows, f"s string, lines array<string>, coarse {clause}, f {clause}, w {clause}")
    only = lambda name, *needed: F.when(F.col("s").isin(*needed), F.col(name)).otherwise(F.raise_error("made").cast(clause))
    found = A.aligned_spans(df, only("f", "split", "words", "lost"), only("w", "words")).collect()
    whole = A.line_spans(A.decide(df.withColumnsRenamed({"f": "fine", "w": "words"}))).collect()
    shown = lambda some: {r.s: (r.decision, r.exact, [tuple(x) for x in r.spans]) for r in some}
    assert shown(found) == shown(whole)
    assert shown(found)["words"][2] == [(0.0, 1.5), (1.5, 2.0)] and shown(found)["lost"][:2] == ("fallback", True)


def test_running_measures_sort_their_rows_once(spark):
    """F15"""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("a", i, 1) for i in range(5)] + [("b", 0, 4)], "k string, pos bigint, v bigint")
        got = running(df, ["k"], ["pos"], [Running("before", "sum", F.col("v"))], chunk_of("pos", 2))
        assert {(r.k, r.pos): r.before for r in got.collect()} == {**{("a", i): i for i in range(5)}, ("b", 0): 0}
        plan = running(df, ["k"], ["pos"], [Running("before", "sum", F.col("v"))])._jdf.queryExecution().executedPlan().toString()
        assert sum("Sort [" in line and "pos#" in line for line in plan.split("\n")) == 1
        assert plan.index("SortMergeJoin") < plan.index("Window [")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    words = spark.createDataFrame([("a", 0, "It's A-b", 0.0, 1.0), ("a", 1, None, 1.0, 2.0), ("a", 2, "C", 2.0, 3.0)],
                                  "k string, pos bigint, text string, start double, end double")
    tokens = sorted(SR.word_tokens(words, ["k"]).collect())
    assert [tuple(r)[1:] for r in tokens] == [(0, "it's", 0.0, 1.0), (1, "a", 0.0, 1.0), (2, "b", 0.0, 1.0), (3, "c", 2.0, 3.0)]


def test_fallback_words_are_looked_for_once(spark):
    """F17"""
    df = spark.createDataFrame([(1, ["It's A", "--", "b"], 2.0), (2, [], 1.0), (3, ["é"], 1.0)], "d int, lines array<string>, s double")
    got = A.fallback_word_rows(df, ["d"], F.col("lines"), F.col("s"))
    assert _plan(got).count("regexp_extract_all") == 1
    whole = A.unfold(df, ["d"], A.fallback_words(A.fallback_clauses(F.col("lines"), F.col("s"))), "pos", "w").select("d", "pos", "w.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
