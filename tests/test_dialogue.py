from pyspark.sql import functions as F

from cuesheet.functions import text as T
from cuesheet.operators import dialogue as D

KEYS = ["script"]
SCHEMA = "script string, ordinal bigint, kind string, text string, label string, speakers array<string>"
KNOWN = ["anna", "ben"]


def _contents(spark, parts):
    rows = [("s", i, kind, text, label, KNOWN) for i, (kind, text, label) in enumerate(parts)]
    folded = D.items(D.dialogue_lines(spark.createDataFrame(rows, SCHEMA), KEYS), KEYS)
    return folded, D.contents(folded, KEYS)


def test_continuation_and_paragraph_are_one_turn(spark):
    text = "\n  Anna: First sentence.\n  Continued line.\n\n  Another paragraph.\n"
    _, contents = _contents(spark, [("text", text, None)])
    assert [(r.kind, r.speaker_key, r.spoken_text) for r in contents.collect()] == [
        ("line", "anna", "First sentence. Continued line. Another paragraph.")
    ]


def test_inline_item_and_normalised_script(spark):
    parts = [("text", "Anna: First line.", None), ("audio", None, "<sound>"), ("text", "BEN : It’s fine: yes", None)]
    _, contents = _contents(spark, parts)
    rows = contents.orderBy("content_idx").collect()
    assert [r.kind for r in rows] == ["line", "audio", "line"]
    script = D.script_blocks(D.normalized_lines(contents, KEYS), KEYS).first().normalized_script
    assert script == "Speaker 1: First line.\nSpeaker 2: It's fine: yes"
    back = D.parse_normalized(
        D.script_blocks(D.normalized_lines(contents, KEYS), KEYS).withColumn("n_voices", F.lit(2)), KEYS
    ).orderBy("pos")
    assert [(r.speaker_no, r.text, r.error) for r in back.collect()] == [
        (1, "First line.", None),
        (2, "It's fine: yes", None),
    ]


def test_text_after_inline_item_needs_a_speaker(spark):
    folded, _ = _contents(spark, [("text", "Anna: a", None), ("audio", None, "x"), ("text", "loose", None)])
    assert D.stray_text(folded).count() == 1
    folded, _ = _contents(spark, [("text", "someone: a\nAnna: b", None)])
    assert [r["item"] for r in D.stray_text(folded).collect()] == [0]


def test_empty_turn_is_dropped_but_sets_the_speaker(spark):
    _, contents = _contents(spark, [("text", "Anna:\nBen: hi\nanna:\nlater", None)])
    assert [(r.speaker_key, r.spoken_text) for r in contents.orderBy("content_idx").collect()] == [
        ("ben", "hi"),
        ("anna", "later"),
    ]


def test_segment_labels(spark):
    parts = [("text", "Anna: " + "x" * 40, None), ("audio", None, "door"), ("audio", None, "bell")]
    _, contents = _contents(spark, parts)
    names = {r.segment: r.name for r in D.segment_labels(contents, KEYS).collect()}
    assert names == {0: "x" * 30, 1: "bell", 2: "script end"}


def test_text_helpers(spark):
    row = spark.createDataFrame([("  a ", "Speaker 1: Hello,  big world", "Café It's 9")], "a string, b string, c string")
    got = row.select(
        T.strip(F.col("a")).alias("a"),
        T.request_label(F.col("b")).alias("b"),
        T.tokens(F.col("c")).alias("c"),
        T.file_label(F.lit("--Hi, you!"), "x").alias("d"),
        T.file_label(F.lit("?!"), "audio").alias("e"),
        T.split_lines(F.lit("a\r\nb c\x0bd")).alias("f"),
    ).first()
    assert got.a == "a" and got.b == "Hello, big world" and got.c == ["caf", "it's", "9"]
    assert got.d == "hi_you" and got.e == "audio" and got.f == ["a", "b", "c", "d"]
