import pytest
from pyspark.sql import functions as F

from cuesheet.operators import blocks as B
from cuesheet.operators import timeline as L

RATE = 4
SCHEMA = "c string, idx bigint, samples array<float>, pre_gap double, post_gap double, length double"


def _production(spark, clips):
    rows = [("p", i, list(map(float, s)), pre, post, length) for i, (s, pre, post, length) in enumerate(clips)]
    children = spark.createDataFrame(rows, SCHEMA).withColumn("frames", F.size("samples").cast("bigint"))
    placed = L.place(children, ["c"], RATE, chunk_rows=1)
    summary = L.summarise(placed, ["c"], RATE)
    offset = placed.join(summary.select("c", "min_start"), "c").withColumn("start_frame", F.col("start_frame") - F.col("min_start"))
    full = L.with_silence(L.mix(offset, ["c"]), summary.select("c", "frames"), ["c"])
    trimmed = L.trim_to_boundary(summary, RATE)
    kept = {r.frame: r.value for r in L.trim_frames(full, trimmed, ["c"]).collect()}
    n = trimmed.first().final_frames
    return [kept.get(i, 0.0) for i in range(n)]


@pytest.mark.parametrize(
    "clips, want",
    [
        ([([1], 0.0, 0.5, None), ([2], 0.25, 0.0, None)], [1, 0, 0, 0, 2]),
        ([([1, 2], 0.0, 0.0, 0.0), ([10, 20], 0.0, 0.0, None)], [11, 22]),
        ([([1, 2], -0.25, 0.0, None)], [2]),
        ([([1, 2], 0.0, -0.25, None)], [1]),
        ([([1, 2], 0.0, 0.0, None), ([3], 0.25, 0.0, None)], [1, 2, 0, 3]),
        ([([1], 0.25, 0.0, None)], [0, 1]),
    ],
)
def test_golden_timelines(spark, clips, want):
    assert _production(spark, clips) == want


def test_placement_report(spark):
    rows = [("p", 0, 2, 0.0, 0.0, None, "a"), ("p", 1, 1, 0.25, 0.0, None, "b")]
    schema = "c string, idx bigint, frames bigint, pre_gap double, post_gap double, length double, label string"
    report = L.placement_report(L.place(spark.createDataFrame(rows, schema), ["c"], RATE), RATE)
    assert sorted(r.message for r in report.collect()) == [
        "places a from 0.000s to 0.500s",
        "places b from 0.750s to 1.000s",
    ]


def test_splice_keeps_the_audio(spark):
    clip = spark.createDataFrame([("s", [1.0, 2.0, 3.0, 4.0])], "clip string, samples array<float>")
    markers = spark.createDataFrame([("s", [0, 2, 4])], "clip string, frames array<bigint>")
    slices = L.slice_markers(clip, markers, "clip").select("clip", "slice_no", "samples")
    inline = spark.createDataFrame([("s", 0, [8.0, 9.0])], "clip string, item_no bigint, samples array<float>")
    rows = L.splice(slices, inline, ["clip"]).orderBy("idx").collect()
    assert [v for r in rows for v in r.samples] == [1, 2, 8, 9, 3, 4]


def test_rounding_and_truncation(spark):
    clip = spark.createDataFrame([("s", [float(i) for i in range(10)])], "clip string, samples array<float>")
    assert L.slice_from(clip, F.lit(0.25), 8).first().samples == [2, 3, 4, 5, 6, 7, 8, 9]
    assert L.slice_from(clip, F.lit(0.3), 9).first().first_frame == 2
    half = L.slice_time(clip, F.lit(0.25), F.lit(0.35), 10).first()
    assert (half.first_frame, half.last_frame, half.samples) == (2, 4, [2, 3])
    assert L.slice_time(clip, F.lit(0.5), F.lit(0.1), 10).first().error


def test_nested_composition(spark):
    schema = (
        "production string, node_id string, parent_id string, depth int, idx bigint, is_container boolean, "
        "frames bigint, pre_gap double, post_gap double, length double"
    )
    rows = [
        ("p", "root", None, 0, 0, True, 0, 0.0, 0.0, None),
        ("p", "a", "root", 1, 0, False, 2, 0.0, 0.5, None),
        ("p", "b", "root", 1, 1, True, 0, 0.0, 0.0, None),
        ("p", "b0", "b", 2, 0, False, 3, -0.25, 0.0, None),
        ("p", "b1", "b", 2, 1, False, 1, 0.25, 0.0, None),
    ]
    placements, summaries = L.compose_tree(spark.createDataFrame(rows, schema), RATE, 2)
    starts = {r.node_id: r.abs_start for r in placements.collect()}
    # b starts one frame early, as its first child does, and is five frames long.
    assert starts == {"a": 0, "b": 3, "b0": 3, "b1": 7}
    assert {r.node_id: r.frames for r in summaries.collect()} == {"b": 5, "root": 8}


def test_mix_blocks_equal_frames(spark):
    rows = [("p", s, [float(s % 7 + i) for i in range(9)]) for s in (0, 3, 3, 5, 17, 40, 41)]
    placed = spark.createDataFrame(rows, "c string, start_frame bigint, samples array<float>")
    frames = {r.frame: r.value for r in L.mix(placed, ["c"]).collect()}
    blocks = B.mix_blocks(placed, ["c"], 8).collect()
    assert len({r.block_no for r in blocks}) == len(blocks)
    by_block = {r.block_no * 8 + i: v for r in blocks for i, v in enumerate(r.samples) if v}
    assert by_block == {k: v for k, v in frames.items() if v}
