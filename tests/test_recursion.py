"""Filters and followers over blocks against whole clips, for any size of blocks and of groups of steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import blocks as B
from cuesheet.operators import recursion as R

RATE = 8000
LENGTHS = (10, 11, 400, 2011)
LEVELS = {"threshold_db": -28.0, "ratio": 2.8, "attack_ms": 5.0, "release_ms": 240.0, "makeup_db": 2.2}


def _signal(n):
    rng = np.random.default_rng(n)
    burst = np.where(np.arange(n) // 300 % 3 == 0, 0.8, 0.05)
    return (burst * rng.standard_normal((2, n))).astype(np.float32)


@pytest.fixture(scope="module")
def clips(spark):
    rows = [(n, *_signal(n).tolist()) for n in (*LENGTHS, 9)]
    return spark.createDataFrame(rows, "clip_id bigint, l array<float>, r array<float>").cache()


def _blocks(clips, size):
    return B.cut_blocks(clips, F.col("l"), F.col("r"), size)


def _whole(blocks):
    found = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.clip_id, r.block_no)):
        found.setdefault(r.clip_id, []).append(np.stack([r.l, r.r]))
    return {k: np.concatenate(v, axis=1) for k, v in found.items()}


def _direct(stage, n):
    return stage.kernel(_signal(n)[None].astype(np.float64), True, True)[0].astype(np.float32)


@pytest.mark.parametrize("size, group", [(7, 4), (700, 2), (5000, 1024)])
def test_recursion_equals_the_whole_clip(clips, size, group):
    blocks = _blocks(clips, size)
    for made, stage in (
        (R.band_filter(blocks, "highpass", 20.0, RATE, size, group), B.band_filter("highpass", 20.0, RATE)),
        (R.tilt(blocks, -1.4, 1.6, RATE, size, group), B.tilt(-1.4, 1.6, RATE)),
    ):
        got = _whole(made)
        assert set(got) == set(LENGTHS)  # what is too short to filter is left out
        for n in LENGTHS:
            assert np.allclose(got[n], _direct(stage, n), atol=1e-7)
    got = _whole(R.compressor(blocks, **LEVELS, rate=RATE, group=group))
    assert set(got) == {*LENGTHS, 9}
    for n in (*LENGTHS, 9):
        assert np.allclose(got[n], _direct(B.compressor(**LEVELS, rate=RATE), n), atol=1e-7)


def test_states_are_exact_whatever_the_blocks(spark):
    """Levels before every block, in doubles, through three levels of groups."""
    rng = np.random.default_rng(5)
    peaks = np.abs(rng.standard_normal(600)) * (rng.random(600) < 0.1)
    attack, release = B.follower_rates(5.0, 240.0, RATE)
    steps = [(1, k, m.tolist()) for k, m in enumerate(R.level_maps(peaks.reshape(30, 20), 4.0, attack, release))]
    table = spark.createDataFrame(steps, "clip_id bigint, no bigint, step array<double>")
    got = {r.no: r.state[0] for r in R.scan(table, 30, R.compose_levels, R.move_level, np.zeros(1), 4).collect()}
    level, want = 0.0, {}
    for i, peak in enumerate(peaks):
        if i % 20 == 0:
            want[i // 20] = level
        keep = attack if peak > level else release
        level = keep * level + (1 - keep) * peak
    assert max(abs(got[k] - want[k]) for k in want) < 1e-11 and len(got) == 30


@pytest.mark.parametrize("attack, release", [(0.9, 0.999), (0.999, 0.9), (0.5, 0.9999)])
@pytest.mark.parametrize("n", [1, 2, 7, 50, 1000])
def test_follow_and_its_map_against_a_loop(n, attack, release):
    rng = np.random.default_rng(n)
    peaks = np.abs(rng.standard_normal((3, n))) * rng.choice([0.1, 1, 0], (3, n))
    start = rng.random(3) * 3
    levels, slopes = B.follow(peaks, start, attack, release)
    level, slope = start.copy(), np.ones(3)
    for i in range(n):
        keep = np.where(peaks[:, i] > level, attack, release)
        level, slope = keep * level + (1 - keep) * peaks[:, i], slope * keep
        assert np.abs(levels[:, i] - level).max() < 1e-12
    assert np.allclose(slopes, slope)
    x = np.linspace(0, 4, 57)
    for block, step in zip(peaks, R.level_maps(peaks, 4.0, attack, release), strict=True):
        want = B.follow(np.broadcast_to(block, (57, n)), x, attack, release)[0][:, -1]
        assert np.abs(R.move_level(step, x) - want).max() < 1e-11


def test_tables_without_rows_and_without_sound(clips, spark):
    none = _blocks(clips.limit(0), 50)
    assert R.compressor(none, **LEVELS, rate=RATE).count() == 0
    assert R.band_filter(none, "lowpass", 200.0, RATE, 50).count() == 0
    silent = spark.createDataFrame([(1, [0.0] * 40, [0.0] * 40)], "clip_id bigint, l array<float>, r array<float>")
    blocks = _blocks(silent, 12)
    for made in (R.compressor(blocks, **LEVELS, rate=RATE), R.tilt(blocks, 1.0, 1.0, RATE, 12)):
        assert not _whole(made)[1].any() and made.count() == 4
