import pytest
from pyspark.sql import functions as F

from cuesheet.operators import validation as V
from cuesheet.plans import production
from cuesheet.sources import documents as S

MAP = "<speaker-map>\n  anna: anna.wav\n  ben: ben.wav\n</speaker-map>"


def _nodes(spark, *bodies):
    rows = [(str(i), "p.xml", f"<production>{b}</production>") for i, b in enumerate(bodies)]
    return S.shred(spark.createDataFrame(rows, "doc_id string, source string, xml string"))


def test_tree_shape(spark):
    nodes = _nodes(spark, MAP + "<script>Anna: a<sound ref='x'/>\nBen: b</script>")
    rows = nodes.orderBy("node_id").collect()
    assert [(r.tag, r.kind, r.depth, r.ordinal) for r in rows if r.depth < 2] == [
        ("production", "element", 0, 0), ("speaker-map", "element", 1, 0), ("script", "element", 1, 1),
    ]
    assert [r.text for r in rows if r.tag == "speaker-map"] == ["anna: anna.wav\nben: ben.wav"]
    inside = [(r.kind, r.text) for r in rows if r.parent_tag == "script"]
    assert inside == [("text", "Anna: a"), ("element", ""), ("text", "\nBen: b")]


@pytest.mark.parametrize(
    "body, message",
    [
        (MAP + "<script><sound/></script>", "requires either a ref attribute or text content"),
        (MAP + "<script><sound ref='door'>window</sound></script>", "text content must match the ref attribute"),
        (MAP + "<script><sound ref=' '/></script>", "ref attribute cannot be empty"),
        (MAP + "<scene/>", "does not allow child element <scene> <production>"),
        (MAP + "<script>", "mismatched tag"),
        ("<script>Anna: x</script>", "requires a <speaker-map> to be planned before it"),
        (MAP + MAP, "may contain only one <speaker-map>"),
        (MAP + "<script post_gap='later'/>", "post_gap must be a number of seconds"),
        (MAP + "<script post_gap=' '/>", "post_gap cannot be empty"),
        (MAP + "<script pre_gap='1.5d'/>", "pre_gap must be a number of seconds"),
        (MAP + "<script length='1.0' post_gap='0.5'/>", "may not specify both length and post_gap"),
        (MAP + "<script length='-1.0'/>", "must be non-negative seconds"),
        (MAP + "<script pre_margin='0.5'/>", "cannot be set on document nodes"),
        (MAP + "<script preset='missing-preset'/>", "Unknown preset 'missing-preset'"),
        (MAP + "<script preset=' '/>", "preset attribute cannot be empty"),
        (MAP + "<script tts='x'/>", "must be either 'vibevoice' or 'qwen'"),
        ("loose", "does not allow text content"),
    ],
)
def test_errors(spark, body, message):
    found = V.errors(_nodes(spark, body)).collect()
    assert any(message in r.formatted for r in found), [r.formatted for r in found]


def test_sound_document_has_no_errors(spark):
    body = MAP + "<script pre_gap='1_0.5' tts='QWEN' preset='Narrator2'>Anna: a<mark>cut</mark></script><mark id='cut'/>"
    nodes = _nodes(spark, body)
    assert V.errors(nodes).count() == 0
    planned = {r.tag: r for r in V.plan_nodes(nodes).collect()}
    assert planned["script"].pre_gap == 10.5 and planned["script"].tts == "qwen" and planned["mark"].value == "cut"


def test_location_fallbacks(spark):
    schema = "s string, l int, c int"
    rows = [(None, None, None), ("x", None, None), (None, 3, None), ("x", 3, 4)]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(V.location(F.col("s"), F.col("l"), F.col("c"))).collect()]
    assert got == ["<unknown>", "x", "<string>:3", "x:3:4"]


def test_speaker_maps(spark):
    nodes = _nodes(spark, "<speaker-map>Anna: a.wav\nANNA: b.wav</speaker-map>", "<speaker-map>- x</speaker-map>", "<speaker-map>{}</speaker-map>")
    found = sorted(r.message for r in S.speaker_errors(S.speaker_entries(nodes)).collect())
    assert found[0].startswith("Speaker 'ANNA' is defined more than once")
    assert "must be a mapping" in found[1] and "did not define any speakers" in found[2]


def test_plan_with_inline_sound(spark):
    body = MAP + "<script>Anna: one two<sound ref='x' post_gap='-0.5'/>Ben: three four</script><script post_gap='0.5'>Ben: five</script>"
    documents = spark.createDataFrame([("d", "p.xml", f"<production>{body}</production>"), ("e", "e.xml", "<play/>")], "doc_id string, source string, xml string")
    voices = spark.createDataFrame([("/v/anna.wav",), ("/v/Ben.wav",)], "path string")
    planned = production.plan(documents, voices, "/v")
    assert {r.doc_id for r in planned.errors.collect()} == {"e"}
    scripts = {r.script_id: r for r in planned.requests.collect()}
    first = scripts[min(scripts)]
    assert first.normalized_script == "Speaker 1: one two\nSpeaker 2: three four"
    assert first.voice_samples == ["/v/anna.wav", "/v/Ben.wav"]
    ids = sorted(scripts)
    sound = planned.plan_nodes.where("tag = 'sound'").first().node_id
    clips = spark.createDataFrame([("d", ids[0], 8), ("d", ids[1], 3), ("d", sound, 4)], "doc_id string, node_id int, frames bigint")
    placements, trimmed = production.timeline(planned, clips, 4)
    starts = {r.node_id: (r.abs_start, r.frames) for r in placements.collect()}
    # Two slices of four frames around the sound, which the second slice overlaps by two.
    assert starts[f"{ids[0]}/0"] == (0, 4) and starts[str(sound)] == (4, 4) and starts[f"{ids[0]}/1"] == (6, 4)
    assert starts[str(ids[1])] == (10, 3)
    assert trimmed.first().final_frames == 13 + 2


def test_cut_and_sounds(spark):
    first = "<script>Anna: one<mark id='cut'/>Ben: two</script>"
    body = MAP + "<script>Anna: zero</script>" + first + "<sound>door</sound>"
    lost = MAP + "<sound ref='bell'/>"
    rows = [("d", "p.xml", f"<production>{body}</production>"), ("e", "e.xml", f"<production>{lost}</production>")]
    documents = spark.createDataFrame(rows, "doc_id string, source string, xml string")
    voices = spark.createDataFrame([("/v/anna.wav",), ("/v/ben.wav",)], "path string")
    sounds = spark.createDataFrame([("a/door.wav",), ("a/bell.wav",), ("b/bell.wav",)], "path string")
    planned = production.plan(documents, voices, "/v", sounds, "/s")
    errors = planned.errors.collect()
    assert [(r.doc_id, "matched multiple files" in r.message) for r in errors] == [("e", True)]
    assert planned.sounds.where("doc_id = 'd'").first().resolved_path == "/s/a/door.wav"
    targets = spark.createDataFrame([("d", "cut")], "doc_id string, mark string")
    left = production.cut_requests(planned, targets).collect()
    assert [r.normalized_script for r in left] == ["Speaker 1: one\nSpeaker 2: two"]
    unknown = spark.createDataFrame([("d", "nope")], "doc_id string, mark string")
    assert production.cut_problems(planned, targets).count() == 0
    assert production.cut_problems(planned, unknown).first().message == "Unknown or ambiguous audio mark 'nope'"
    ids = {r.script_id for r in planned.requests.collect()}
    script, sound = left[0].script_id, planned.plan_nodes.where("tag = 'sound'").first().node_id
    clips = spark.createDataFrame([("d", i, 4) for i in ids] + [("d", sound, 3)], "doc_id string, node_id int, frames bigint")
    placements, trimmed = production.timeline(planned, clips, 4, cut_before=targets)
    starts = {r.node_id: (r.abs_start, r.frames) for r in placements.collect()}
    # Only the slice after the mark is left of the script, then the sound.
    assert starts[f"{script}/1"] == (0, 2) and f"{script}/0" not in starts and starts[str(sound)] == (2, 3)
    assert trimmed.first().final_frames == 5


def test_long_texts_are_linear():
    """The time of a long run of text grows with its length, not with its square."""
    import time

    from cuesheet.sources.documents import _shred_text

    seconds = []
    for lines in (20_000, 80_000):
        begin = time.perf_counter()
        rows = _shred_text("<production><script>" + "a line of text\n" * lines + "</script></production>")
        seconds.append(time.perf_counter() - begin)
        assert len(rows) == 3 and len(rows[2]["text"]) == 15 * lines
    assert seconds[1] < 8 * seconds[0] + 0.5
