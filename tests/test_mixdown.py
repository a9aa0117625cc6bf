"""Plans to audio: moves of blocks, buses, and a whole production as a WAV file, against numpy."""

import os
import tempfile
import wave

import numpy as np
from pyspark.sql import functions as F

from cuesheet.operators import blocks as B
from cuesheet.operators import mixdown as MX
from cuesheet.operators import timeline as L
from cuesheet.operators.presets import PRESETS
from cuesheet.plans import production
from cuesheet.sources import wav

RATE = 8000
BLOCK = 700


def noise(seed, frames):
    rng = np.random.default_rng(seed)
    return (0.2 * rng.standard_normal((2, frames))).astype(np.float32)


def clips(spark, sounds, id_type="string"):
    rows = [(*key, x[0].tolist(), x[1].tolist()) for key, x in sounds.items()]
    names = "clip_id " + id_type if len(rows[0]) == 3 else "doc_id string, node_id int"
    df = spark.createDataFrame(rows, f"{names}, l array<float>, r array<float>")
    if len(rows[0]) == 3:
        return B.cut_blocks(df, F.col("l"), F.col("r"), BLOCK)
    keyed = B.cut_blocks(df.withColumn("clip_id", F.struct("doc_id", "node_id")), F.col("l"), F.col("r"), BLOCK)
    return keyed.select("clip_id.*", "block_no", "start_frame", "total", "l", "r")


def whole(blocks):
    found = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.clip_id, r.block_no)):
        assert r.start_frame == r.block_no * BLOCK
        found.setdefault(r.clip_id, []).append(np.stack([r.l, r.r]))
        assert sum(x.shape[1] for x in found[r.clip_id]) == min(r.total, r.start_frame + BLOCK)
    return {k: np.concatenate(v, axis=1) for k, v in found.items()}


def run(preset, x):
    """A preset on a whole clip, stage by stage."""
    for stage, params in PRESETS[preset]:
        x = B.local_stage(stage, params, RATE).kernel(x[None].astype(np.float64), True, True)[0].astype(np.float32)
    return x


def test_moves(spark):
    """Parts of clips, also past their ends, over block edges and on top of each other."""
    sounds = {("a",): noise(1, 2000), ("b",): noise(2, 701)}
    moves = [("a", "x", 0, 2000, 5), ("a", "x", 650, 760, 0), ("b", "x", 700, 900, 1400), ("b", "y", 0, 701, 699), ("a", "y", 9, 9, 0), ("a", "y", 1990, 2500, 0)]
    df = spark.createDataFrame(moves, "clip_id string, target string, first bigint, last bigint, at bigint")
    lengths = spark.createDataFrame([("x", 2005), ("y", 1400), ("z", 0)], "clip_id string, frames bigint")
    got = whole(MX.move(clips(spark, sounds), df, lengths, BLOCK))
    want = {"x": np.zeros((2, 2005)), "y": np.zeros((2, 1400))}
    for clip, target, first, last, at in moves:
        part = sounds[(clip,)][:, first:last]
        want[target][:, at : at + part.shape[1]] += part
    assert set(got) == {"x", "y"}
    for target in want:
        assert np.allclose(got[target], want[target], atol=1e-6)


def test_buses_inside_buses(spark):
    """A bus in a bus, a leaf with a preset, and a container without one: each preset hears just its own contents."""
    schema = (
        "production string, node_id string, parent_id string, depth int, idx bigint, is_container boolean, frames bigint, "
        "pre_gap double, post_gap double, length double, preset string, clip_id string, first bigint"
    )
    s = {name: noise(k, n) for k, (name, n) in enumerate([("a", 900), ("b", 500), ("c", 1500), ("d", 40)])}
    rows = [
        ("p", "root", None, 0, 0, True, 0, 0.0, 0.0, None, None, None, 0),
        ("p", "outer", "root", 1, 0, True, 0, 0.0, 0.0, None, "echo", None, 0),
        ("p", "plain", "outer", 2, 0, True, 0, 0.0, 0.0, None, None, None, 0),
        ("p", "a", "plain", 3, 0, False, 800, 0.0, 0.0, None, None, "a", 100),
        ("p", "b", "plain", 3, 1, False, 500, -0.01, 0.0, None, "half", "b", 0),
        ("p", "inner", "outer", 2, 1, True, 0, 0.0, 0.0, None, "half", None, 0),
        ("p", "c", "inner", 3, 0, False, 1500, 0.0, 0.0, None, None, "c", 0),
        ("p", "d", "root", 1, 1, False, 40, 0.05, -0.002, None, None, "d", 0),
        ("q", "root", None, 0, 0, True, 0, 0.0, 0.0, None, None, None, 0),
    ]
    placements, summaries = L.compose_tree(spark.createDataFrame(rows, schema), RATE, 3)
    ends = L.trim_to_boundary(summaries.where("depth = 0"), RATE)
    treat = MX.by_chain({"half": B.Local(lambda x, _, __: x * 0.5), "echo": B.echoes([(300, 0.5, 0.25)], 1.0)}, BLOCK)
    got = whole(MX.mix_tree(placements, ends, clips(spark, {(k,): x for k, x in s.items()}), treat, 3, BLOCK))
    plain = np.zeros((2, 1220))
    plain[:, :800] += s["a"][:, 100:]
    plain[:, 720:1220] += 0.5 * s["b"]
    bus = np.concatenate([plain, 0.5 * s["c"]], axis=1)
    mono = bus.mean(axis=0)
    bus[0, 300:] += 0.5 * mono[:-300]
    bus[1, 300:] += 0.25 * mono[:-300]
    want = np.concatenate([bus, np.zeros((2, 400)), s["d"][:, :24]], axis=1)
    assert set(got) == {"p"} and np.allclose(got["p"], want, atol=1e-6)


def test_document_to_wav(spark):
    """Two scripts, one with a preset and a sound between its lines, gaps and an overlap, to a file."""
    head = "<speaker-map>Anna: anna.wav\nBen: ben.wav</speaker-map>"
    body = (
        head + "<script preset='narrator1'>Anna: one two<sound ref='x' post_gap='-0.05'/>Ben: three four</script>"
        "<script pre_gap='0.1' post_gap='0.25'>Ben: five</script>"
    )
    documents = spark.createDataFrame([("d", "p.xml", f"<production>{body}</production>")], "doc_id string, source string, xml string")
    planned = production.plan(documents, spark.createDataFrame([("/v/anna.wav",), ("/v/ben.wav",)], "path string"), "/v")
    assert planned.errors.count() == 0
    first, second = sorted(r.script_id for r in planned.requests.select("script_id").distinct().collect())
    sound = planned.plan_nodes.where("tag = 'sound'").first().node_id
    s = {first: noise(5, 4000), second: noise(6, 1500), sound: noise(7, 1100)}
    done = production.audio(planned, clips(spark, {("d", k): x for k, x in s.items()}), RATE, BLOCK)
    got = whole(done)["d"]
    # Half of the tokens stand before the sound, whose end the second slice overlaps by 400 frames.
    script = np.zeros((2, 2000 + 1100 - 400 + 2000))
    script[:, :2000] += s[first][:, :2000]
    script[:, 2000:3100] += s[sound]
    script[:, 2700:] += s[first][:, 2000:]
    want = np.concatenate([run("narrator", script.astype(np.float32)), np.zeros((2, 800)), s[second], np.zeros((2, 2000))], axis=1)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-4
    folder = tempfile.mkdtemp(prefix="cuesheet-wav-")
    wav.write_wavs(done.withColumn("path", wav.output_path(F.lit("p.xml"))), folder, RATE)
    with wave.open(os.path.join(folder, "p.wav")) as handle:
        assert (handle.getnchannels(), handle.getframerate(), handle.getnframes()) == (2, RATE, want.shape[1])
        data = np.frombuffer(handle.readframes(want.shape[1]), "<i2").reshape(-1, 2).T / 32767
    assert np.abs(data - np.clip(want, -1, 1)).max() < 2e-4


def test_audio_with_cut_and_master(spark):
    head = "<speaker-map>Anna: anna.wav</speaker-map>"
    body = head + "<script>Anna: one</script><script>Anna: two<mark id='m'/>Anna: three</script>"
    documents = spark.createDataFrame([("d", "p.xml", f"<production>{body}</production>")], "doc_id string, source string, xml string")
    planned = production.plan(documents, spark.createDataFrame([("/v/anna.wav",)], "path string"), "/v")
    ids = sorted(r.script_id for r in planned.requests.select("script_id").distinct().collect())
    s = {ids[0]: noise(1, 900), ids[1]: noise(2, 3000)}
    cut = spark.createDataFrame([("d", "m")], "doc_id string, mark string")
    blocks = clips(spark, {("d", k): x for k, x in s.items()})
    got = whole(production.audio(planned, blocks, RATE, BLOCK, cut_before=cut))["d"]
    assert np.allclose(got, s[ids[1]][:, 1500:], atol=1e-6)
    loud = whole(production.audio(planned, blocks, RATE, BLOCK, cut_before=cut, master="master"))["d"]
    gain = loud[0, 10] / got[0, 10]
    assert gain != 1.0 and np.allclose(loud, got * gain, atol=1e-5)
    # A script without its clip: the production is left out.
    assert production.audio(planned, blocks.where(F.col("node_id") == ids[0]), RATE, BLOCK).count() == 0


def test_slices_chains_and_lines(spark):
    """Long clips in many blocks: no part depends on where the blocks are cut."""
    sounds = {("a",): noise(1, 5000), ("b",): noise(2, 1300)}
    blocks = clips(spark, sounds)
    a, b = sounds[("a",)], sounds[("b",)]
    slices = [("a", "s1", 0.1, 0.35), ("a", "s2", 0.6, None), ("b", "s3", 0.1, 9.0), ("b", "s4", 0.2, 0.1), ("b", "s5", 5.0, None)]
    df = spark.createDataFrame(slices, "clip_id string, target string, start double, end double")
    got = whole(MX.slice_blocks(blocks, df, RATE, BLOCK))
    want = {"s1": a[:, 800:2800], "s2": a[:, 4800:], "s3": b[:, 800:]}
    assert set(got) == set(want) and all(np.array_equal(got[k], want[k]) for k in want)
    assert [r.target for r in MX.slice_problems(df).collect()] == ["s4"]
    marks = spark.createDataFrame([("a", "x", [0, 1701, 1701, 5000])], "clip_id string, target string, frames array<bigint>")
    inline = spark.createDataFrame([("b", "x", 1, 0, 1300), ("b", "x", 3, 5, 6)], "clip_id string, target string, idx bigint, first bigint, last bigint")
    got = whole(MX.chain(blocks, MX.marker_parts(marks).unionByName(inline), BLOCK))
    assert np.array_equal(got["x"], np.concatenate([a[:, :1701], b, b[:, 5:6], a[:, 1701:]], axis=1))
    lines = spark.createDataFrame([("a", "p", 7), ("b", "p", 3), ("b", "p", 9)], "clip_id string, target string, line_no int")
    assert np.array_equal(whole(MX.join_lines(blocks, lines, BLOCK))["p"], np.concatenate([b, a, b], axis=1))


def test_loudness_moves_hops_only(spark):
    """The energies of hops equal those of frames, and what is shuffled is a row for each hop of each block."""
    blocks = clips(spark, {("a",): noise(3, 9000), ("b",): noise(4, 130)})
    hops = {(r.clip_id, r.hop): (r.s, r.n) for r in B.hop_energies(blocks, 800).collect()}
    for clip, x in (("a", noise(3, 9000)), ("b", noise(4, 130))):
        for k in range(-(-x.shape[1] // 800)):
            part = x[:, k * 800 : k * 800 + 800].astype(np.float64)
            s, n = hops.pop((clip, k))
            assert n == part.shape[1] and abs(s - (part**2).sum()) < 1e-9
    assert not hops
