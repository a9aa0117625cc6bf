"""Keys over audio: the same for any blocks, another for any change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import blocks as B
from cuesheet.operators import requests as R

N = 1000


def _key(spark, l, r, size, rate=48_000, version=1, digest="d", grid=64):
    clips = spark.createDataFrame([(1, l, r)], "clip_id bigint, l array<float>, r array<float>")
    blocks = B.cut_blocks(clips, F.col("l"), F.col("r"), size)
    contents = spark.createDataFrame([(1, digest)], "clip_id bigint, digest string")
    return R.alignment_keys(contents, R.audio_digests(blocks, grid), rate, version).first().key


@pytest.fixture(scope="module")
def pair():
    draw = np.random.default_rng(4)
    return [draw.standard_normal(N).astype(np.float32).tolist() for _ in range(2)]


def test_any_blocks_give_one_key(spark, pair):
    assert len({_key(spark, *pair, size) for size in (7, 64, 100, N)}) == 1


def test_any_change_gives_another_key(spark, pair):
    l, r = pair
    swapped = [*l[:500], l[501], l[500], *l[502:]]
    moved = [*l[64:128], *l[:64], *l[128:]]
    keys = [
        _key(spark, l, r, 100),
        _key(spark, [*l[:-1], float(np.nextafter(np.float32(l[-1]), np.float32(9)))], r, 100),
        _key(spark, swapped, r, 100),
        _key(spark, moved, r, 100),
        _key(spark, r, l, 100),
        _key(spark, l[:-1], r[:-1], 100),
        _key(spark, l, r, 100, rate=44_100),
        _key(spark, l, r, 100, version=2),
        _key(spark, l, r, 100, digest="e"),
    ]
    assert len(set(keys)) == len(keys)


def test_mono_and_empty_clips(spark, pair):
    rows = [(1, 0, 0, 3, [1.0, 2.0, 3.0], None), (2, 0, 0, 3, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), (3, 0, 0, 0, [], [])]
    blocks = spark.createDataFrame(
        rows, "clip_id bigint, block_no bigint, start_frame bigint, total bigint, l array<float>, r array<float>"
    )
    found = {r.clip_id: (r.frames, r.channels, r.audio) for r in R.audio_digests(blocks).collect()}
    assert set(found) == {1, 2} and found[1][:2] == (3, 1) and found[2][:2] == (3, 2) and found[1][2] != found[2][2]
