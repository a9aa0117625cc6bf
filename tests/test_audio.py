"""Block path against whole clips and against the frame path."""

import math
import os
import tempfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import blocks as B
from cuesheet.operators import frames as FR
from cuesheet.operators.presets import PRESETS
from cuesheet.sources import wav

RATE = 8000
N = 3000


def _signal(seed):
    rng = np.random.default_rng(seed)
    t = np.arange(N) / RATE
    burst = np.where((t * 10).astype(int) % 3 == 0, 0.8, 0.05)
    left = burst * np.sin(2 * np.pi * 150 * t) + 0.1 * rng.standard_normal(N)
    return left.astype(np.float32), (0.5 * left + 0.1 * rng.standard_normal(N)).astype(np.float32)


@pytest.fixture(scope="module")
def clips(spark):
    rows = [(i, _signal(i)[0].tolist(), _signal(i)[1].tolist()) for i in range(3)]
    return spark.createDataFrame(rows, "clip_id bigint, l array<float>, r array<float>").cache()


def _blocks(clips, size=700):
    return B.cut_blocks(clips, F.col("l"), F.col("r"), size)


def _whole(blocks):
    rows = sorted(blocks.collect(), key=lambda r: (r.clip_id, r.block_no))
    found = {}
    for r in rows:
        found.setdefault(r.clip_id, []).append(np.stack([r.l, r.r]))
    return {k: np.concatenate(v, axis=1) for k, v in found.items()}


def _direct(stage, seed):
    x = np.stack(_signal(seed))[None].astype(np.float64)
    return stage.kernel(x, True, True)[0]


@pytest.mark.parametrize(
    "stage",
    [
        B.band_filter("highpass", 85.0, RATE),
        B.band_filter("lowpass", 2500.0, RATE),
        B.tilt(-1.4, 1.6, RATE),
        B.compressor(**{**PRESETS["indoor2"][1][1], "release_ms": 20.0}, rate=RATE),
        B.echoes(FR.reflection_taps(RATE, PRESETS["indoor1"][1][1]["taps"]), 0.93),
        B.echoes(FR.repeat_taps(RATE, 44.0, 7.0, 0.58, 4, 0.08), 0.96),
        B.mid_side(1.1, 0.66),
    ],
)
def test_blocks_equal_whole_clip(clips, stage):
    got = _whole(B.run_stage(_blocks(clips), stage, 700))
    for seed in range(3):
        assert np.allclose(got[seed], _direct(stage, seed), atol=3e-6)


def test_compressor_follows_the_definition(clips):
    params = PRESETS["narrator"][1][1]
    got = _direct(B.compressor(**params, rate=RATE), 1)
    l, r = _signal(1)
    level, want = 0.0, []
    a, q = math.exp(-1 / (RATE * 0.005)), math.exp(-1 / (RATE * 0.24))
    for x, y in zip(l, r):
        peak = max(abs(float(x)), abs(float(y)))
        c = a if peak > level else q
        level = c * level + (1 - c) * peak
        db = 20 * math.log10(max(level, 1e-6))
        cut = (-28 + (db + 28) / 2.8) - db if db > -28 else 0.0
        want.append(float(x) * 10 ** ((cut + 2.2) / 20))
    assert np.allclose(got[0], want, atol=1e-9)


def test_filter_passes_and_stops():
    t = np.arange(16000) / RATE
    x = np.stack([np.sin(2 * np.pi * 20 * t), np.sin(2 * np.pi * 1000 * t)])[None]
    stage = B.band_filter("highpass", 200.0, RATE)
    y = stage.kernel(x, True, True)[0][:, 4000:12000]
    assert np.abs(y[0]).max() < 2e-4 and abs(np.abs(y[1]).max() - 1) < 5e-3
    short = np.ones((1, 2, 5))
    assert (stage.kernel(short, True, True) == short).all()


@pytest.mark.parametrize("preset", [p for p in PRESETS if p != "master"])
def test_every_preset_changes_the_clip(clips, preset):
    blocks = _blocks(clips.where("clip_id = 0"))
    wet = B.block_frames_table(B.apply_preset(blocks, preset, RATE, 700))
    rms = FR.difference_rms(wet, B.block_frames_table(blocks)).collect()
    assert len(rms) == 1 and rms[0].rms > 0.01
    assert wet.count() == N


def test_master_reaches_the_target(clips):
    stereo = B.block_frames_table(B.loudness_stage(_blocks(clips), RATE, -20.0))
    again = FR.loudness_gain(stereo, RATE, -20.0).collect()
    assert all(abs(r.loudness + 20.0) < 0.01 for r in again)


def test_noise_level_and_block_equality(clips):
    stereo = FR.stereo_frames(clips, F.col("l"), F.col("r"))
    noisy = FR.add_noise(stereo, -24.0)
    signal = {r.clip_id: r.rms for r in FR.rms(stereo).collect()}
    added = {r.clip_id: r.rms for r in FR.difference_rms(noisy, stereo).collect()}
    for clip, rms in added.items():
        assert abs(rms / signal[clip] - 10 ** (-24 / 20)) < 1e-3
    blocks = B.block_frames_table(B.noise_stage(_blocks(clips), -24.0))
    assert max(r.rms for r in FR.difference_rms(blocks, noisy).collect()) < 1e-6


def test_resample(spark, clips):
    ones = spark.createDataFrame([(0, i, 0, 1.0) for i in range(2400)], "clip_id int, frame bigint, ch int, value float")
    lengths = spark.createDataFrame([(0, 2400)], "clip_id int, frames bigint")
    out = FR.convert_format(ones, lengths, 1, 24_000, 2, 48_000)
    rows = out.collect()
    assert len(rows) == 4800 * 2
    assert all(abs(r.value - 1) < 1e-2 for r in rows if 100 < r.frame < 4700)
    for inp, outp in ((24_000, 48_000), (48_000, 32_000), (22_050, 16_000)):
        stereo = FR.stereo_frames(clips, F.col("l"), F.col("r"))
        mono = stereo.select("clip_id", "frame", F.lit(0).alias("ch"), F.col("l").alias("value"))
        lengths = FR.clip_lengths(stereo)
        want = {(r.clip_id, r.frame): r.value for r in FR.resample(mono, lengths, inp, outp).collect()}
        blocks = B.block_frames_table(B.resample_blocks(_blocks(clips), inp, outp, 700)).collect()
        got = {(r.clip_id, r.frame): r.l for r in blocks}
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_wav_files(spark, clips):
    folder = tempfile.mkdtemp(prefix="cuesheet-wav-")
    named = _blocks(clips).withColumn("path", wav.output_path(F.concat(F.lit("shows/p."), F.col("clip_id").cast("string"), F.lit(".xml"))))
    wav.write_wavs(named, folder, RATE)
    assert sorted(os.listdir(f"{folder}/shows")) == [f"p.{i}.wav" for i in range(3)]
    with wave.open(f"{folder}/shows/p.1.wav") as handle:
        assert (handle.getnchannels(), handle.getframerate(), handle.getnframes()) == (2, RATE, N)
        data = np.frombuffer(handle.readframes(N), "<i2").reshape(-1, 2) / 32767
    assert np.abs(data[:, 0] - np.clip(_signal(1)[0], -1, 1)).max() < 1e-4


def test_custom_stage(clips):
    made = B.apply_custom(_blocks(clips), lambda: (lambda x, s, e: -x), 0, 0, 700)
    assert np.allclose(_whole(made)[2], -np.stack(_signal(2)))


@pytest.mark.parametrize("size", [130, 700, N])
def test_stage_with_a_memory_equals_its_whole_clip(clips, size):
    def factory():
        def leaky(x, state):
            state, made = np.zeros(2) if state is None else state, np.empty_like(x)
            for i in range(x.shape[1]):
                made[:, i] = state = 0.9 * state + x[:, i]
            return made, state

        return leaky

    done = _whole(B.apply_stateful(_blocks(clips, size), factory))
    for clip in range(3):
        want, _ = factory()(np.stack(_signal(clip)).astype(np.float64), None)
        assert np.array_equal(done[clip], want.astype(np.float32))


def test_presets_lose_no_clip(spark):
    """Aliases and spellings are known, none passes, the rest is named: every clip is in one of the two tables."""
    names = ["narrator1", " NARRATOR ", None, "none", "", "moon", "indoor1"]
    signal = _signal(1)
    rows = [(i, signal[0][:900].tolist(), signal[1][:900].tolist(), n) for i, n in enumerate(names)]
    rows.append((7, signal[0][:9].tolist(), signal[1][:9].tolist(), "indoor1"))
    clips = spark.createDataFrame(rows, "clip_id bigint, l array<float>, r array<float>, preset string")
    blocks = _blocks(clips, 300).join(clips.select("clip_id", "preset"), "clip_id")
    done = _whole(B.by_preset(blocks, RATE, 300))
    problems = {r.clip_id: r.message for r in B.preset_problems(blocks).collect()}
    assert set(done) | set(problems) == set(range(8)) and not set(done) & set(problems)
    assert set(problems) == {5, 7} and "Unknown preset 'moon'" in problems[5]
    for plain in (2, 3, 4):
        assert np.array_equal(done[plain], np.stack([signal[0][:900], signal[1][:900]]))
    assert np.array_equal(done[0], done[1]) and not np.array_equal(done[0], done[2])


def test_silence_between(spark):
    placed = spark.createDataFrame([("a", 3, [1.0] * 4), ("a", 40, [2.0])], "key string, start_frame bigint, samples array<double>")
    lengths = spark.createDataFrame([("a", 45), ("b", 12), ("c", 0)], "key string, frames bigint")
    full = B.fill_silence(B.mix_blocks(placed, ["key"], 10), lengths, ["key"], 10).collect()
    by = {(r.key, r.block_no): list(r.samples) for r in full}
    assert sorted(by) == [("a", k) for k in range(5)] + [("b", 0), ("b", 1)]
    assert by["a", 0] == [0.0] * 3 + [1.0] * 4 + [0.0] * 3 and by["a", 4][0] == 2.0 and by["b", 1] == [0.0] * 10
    assert by["a", 2] == [0.0] * 10


def test_equal_starts_are_dealt(spark):
    """A thousand pieces that start together are summed over all salts, and the sum is right."""
    rows = [("a", 5, [1.0, 2.0])] * 1000
    placed = spark.createDataFrame(rows, "key string, start_frame bigint, samples array<double>")
    mixed = B.mix_blocks(placed, ["key"], 10).collect()
    assert len(mixed) == 1 and list(mixed[0].samples)[5:7] == [1000.0, 2000.0]
