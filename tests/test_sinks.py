"""Files written in parts: round trips, retries, missing parts, large headers and named artifacts."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.operators import blocks as B
from cuesheet.plans import production
from cuesheet.sources import debug, wav
from cuesheet.sources.parts import SCHEMA, PartWriter, write_parts


def files_in(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_parts_in_any_order_and_task(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-parts-")
    data = {f"a/f{k}": bytes(np.random.default_rng(k).integers(0, 256, 1000 * k, dtype=np.uint8)) for k in range(1, 5)} | {"empty": b""}
    rows = [(p, at, d[at : at + 300], len(d)) for p, d in data.items() for at in range(0, max(len(d), 1), 300)]
    parts = spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    for target in (folder, f"file://{folder}"):  # the second run replaces the files
        write_parts(parts, target)
        assert files_in(folder) == sorted(data)
        assert all(open(os.path.join(folder, p), "rb").read() == d for p, d in data.items())


def test_failures_leave_the_files_as_they_were(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-parts-")
    write_parts(spark.createDataFrame([("f", 0, b"old", 3)], SCHEMA), folder)
    for rows in ([("f", 0, b"ne", 3)], [("f", 0, b"new", 3), ("f", 1, b"ew", 3)], [("../f", 0, b"x", 1)]):
        with pytest.raises(Exception):
            write_parts(spark.createDataFrame(rows, SCHEMA), folder)
        assert open(folder + "/f", "rb").read() == b"old"
    with pytest.raises(ValueError):
        write_parts(spark.createDataFrame([("f", 0, b"x", 1)], SCHEMA), "s3://bucket/x")


def test_a_task_that_runs_again(spark):
    """Two attempts of one task write the same places; only one counts, and one file is left."""
    folder = tempfile.mkdtemp(prefix="cuesheet-parts-")
    writer = PartWriter(folder, "job")
    rows = [{"path": "f", "at": 0, "content": b"abc", "size": 5}, {"path": "f", "at": 3, "content": b"de", "size": 5}]
    writer.write(iter(rows[:1]))  # an attempt that was lost after its first row
    message = writer.write(iter(rows))
    writer.commit([message, None])
    assert files_in(folder) == ["f"] and open(folder + "/f", "rb").read() == b"abcde"


def test_large_headers():
    """Beyond the limit the sizes have 64 bits; the layout is read back from either form."""
    for floats in (False, True):
        for frames in (0, 10, 600_000_000, 2_000_000_000):
            top = wav.header(2, 48_000, frames, floats)
            assert (top[:4] == b"RF64") == (36 + frames * (8 if floats else 4) > wav.SMALL)
            assert wav.parse_header(top + b"\0" * 64) == wav.Layout(len(top), frames, 2, 48_000, floats)
    with pytest.raises(ValueError):
        wav.parse_header(b"RIFF\0\0\0\0WAVEjunk\0\0\0\0")


@pytest.mark.parametrize("small", [wav.SMALL, 100])
def test_wav_round_trip(spark, small):
    folder = tempfile.mkdtemp(prefix="cuesheet-wav-")
    rng = np.random.default_rng(4)
    rows = [(f"c{k}", *rng.uniform(-1, 1, (2, n)).astype(np.float32).tolist()) for k, n in enumerate((1, 700, 5001))]
    clips = spark.createDataFrame(rows, "clip_id string, l array<float>, r array<float>")
    blocks = B.cut_blocks(clips, F.col("l"), F.col("r"), 350).withColumn("path", F.concat("clip_id", F.lit(".wav"))).repartition(5)
    write_parts(wav.wav_parts(blocks, 8000, True, small), folder)
    back = wav.read_wavs(spark, folder + "/*.wav", 999).collect()
    for name, left, right in rows:
        mine = sorted((r for r in back if r.clip_id.endswith(f"{name}.wav")), key=lambda r: r.block_no)
        assert [v for r in mine for v in r.l] == left and [v for r in mine for v in r.r] == right
        assert {r.total for r in mine} == {len(left)} and {r.rate for r in mine} == {8000}


def test_named_artifacts(spark):
    folder = tempfile.mkdtemp(prefix="cuesheet-debug-")
    requests = spark.createDataFrame([(2, "Zwei: ü", None), (1, "one", 5)], "id int, text string, n int")
    named = debug.artifact_names(requests, "id", ["text"], F.col("text"), "request", "json")
    debug.write_artifacts(named, ["text", "n"], folder)
    names = files_in(folder)
    assert [n[:4] for n in names] == ["000-", "001-"]
    text = open(os.path.join(folder, names[0])).read()
    assert text == '{\n  "n": 5,\n  "text": "one"\n}\n'
    assert json.load(open(os.path.join(folder, names[1]))) == {"n": None, "text": "Zwei: ü"}
    clip = spark.createDataFrame([(0, [0.5, -0.25], [1.5, 0.0], "000-a.wav")], "clip_id int, l array<float>, r array<float>, file_name string")
    cut = B.cut_blocks(clip, F.col("l"), F.col("r"), 8).withColumn("file_name", F.lit("000-a.wav"))
    debug.write_wav_artifacts(cut, folder, 100)
    assert wav.parse_header(open(folder + "/000-a.wav", "rb").read()) == wav.Layout(44, 2, 2, 100, True)


def test_all_errors_have_places(spark):
    """Voices, sounds, speaker maps and stray text name the line and the column, as the document's rules do."""
    head = "<production>\n <speaker-map>Anna: anna.wav</speaker-map>\n"
    bodies = {
        "voice": "<production>\n <speaker-map>Anna: lost.wav</speaker-map>\n <script>Anna: x</script></production>",
        "sound": head + " <sound ref='no'/>\n</production>",
        "stray": head + " <script>stray words</script></production>",
        "twice": "<production>\n <speaker-map>Anna: anna.wav\nANNA: anna.wav</speaker-map><script>Anna: x</script></production>",
    }
    rows = [(k, f"{k}.xml", x) for k, x in bodies.items()]
    documents = spark.createDataFrame(rows, "doc_id string, source string, xml string")
    files = spark.createDataFrame([("/v/anna.wav",)], "path string")
    planned = production.plan(documents, files, "/v", spark.createDataFrame([("a/door.wav",)], "path string"), "/s")
    got = {r.doc_id: r.message for r in planned.errors.collect()}
    assert set(got) == set(bodies)
    assert got["voice"].startswith("voice.xml:2:2: Voice 'lost.wav'") and got["voice"].endswith(" <speaker-map>")
    assert got["sound"].startswith("sound.xml:3:2: Sound 'no'") and got["sound"].endswith(" <sound>")
    assert got["stray"] == "stray.xml:3:2: Scripts may begin only with a recognized `speaker:` stanza <script>"
    assert got["twice"].startswith("twice.xml:2:2: Speaker 'ANNA' is defined more than once")
