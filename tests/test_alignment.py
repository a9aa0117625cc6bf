"""Spans from clauses and words; expected values are those of the recorded cases."""

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import alignment as A

SCHEMA = (
    "lines array<string>, clauses array<struct<text: string, start: double, end: double>>, "
    "words array<struct<text: string, start: double, end: double>>"
)


def _spans(spark, lines, clauses, words=()):
    df = spark.createDataFrame([(lines, clauses, list(words))], SCHEMA)
    row = A.line_spans(df).withColumn("filled", A.fill_gaps(F.col("spans"))).first()
    return [tuple(s) for s in row.spans], [tuple(s) for s in row.filled]


def test_exact_clauses(spark):
    lines = ["First sentence here.", "Second one."]
    raw, _ = _spans(spark, lines, [(lines[0], 12.0, 14.0), (lines[1], 14.0, 19.5)])
    assert raw == [(12.0, 14.0), (14.0, 19.5)]


def test_exact_by_counts_skips_empty_clauses(spark):
    raw, _ = _spans(spark, ["Alpha.", "Bravo Charlie."], [("Alpha", 1.0, 2.0), ("...", 2.0, 2.1), ("Bravo", 2.2, None), ("Charlie", None, 4.0)])
    assert raw == [(1.0, 2.0), (2.2, 4.0)]


def test_words_where_clauses_do_not_fit(spark):
    raw, _ = _spans(
        spark,
        ["Alpha Bravo.", "Charlie Delta."],
        [("Alpha.", 10.0, 10.4), ("Bravo Charlie Delta.", 10.4, 12.0)],
        [("Alpha", 10.0, 10.2), ("Bravo", 10.4, 10.8), ("Delta", 11.5, 12.0)],
    )
    assert raw[0] == (10.0, 10.8) and raw[1][0] is None


def test_missing_line_leaves_the_cursor(spark):
    words = [("Charlie", 2.0, 2.2), ("Delta", 2.3, 2.6), ("Echo", 3.0, 3.2), ("Foxtrot", 3.3, 3.7)]
    raw, filled = _spans(
        spark,
        ["Missing words here.", "Charlie Delta.", "Echo Foxtrot."],
        [("Charlie Delta Echo Foxtrot", 2.0, 3.7)],
        words,
    )
    assert [s[0] for s in raw] == [None, 2.0, 3.0]
    assert filled == [(0.0, 0.0), (2.0, 2.6), (3.0, 3.7)]


def test_greedy_takes_the_earliest_run_after_the_cursor(spark):
    joined = " a b x a b a c a b "
    df = spark.createDataFrame([([["a", "b"], ["q"], ["a"], ["a", "b"], [], ["a", "b"]], joined)], "t array<array<string>>, j string")
    hits = df.select(A.greedy_hits(F.col("t"), F.col("j")).alias("h")).first().h
    assert [(h.first, h.last) for h in hits] == [(0, 1), (None, None), (3, 3), (7, 8), (None, None), (None, None)]


def test_empty_clause_hides_the_ending(spark):
    lines, words = ["Alpha Bravo", "Gone"], [("Alpha", 1.0, 1.2), ("Bravo", 1.3, 1.6), ("Other", 2.0, 2.1), ("Word", 2.2, 2.3)]
    fit = [("Alpha Bravo", 0.9, 1.9), ("Other word", 2.0, 2.3)]
    raw, _ = _spans(spark, lines, fit, words)
    assert raw[0] == (0.9, 1.9)
    raw, _ = _spans(spark, lines, [fit[0], ("--", 1.9, 1.95), fit[1]], words)
    assert raw[0] == (0.9, 1.6)


def test_positions_and_markers(spark):
    spans = "array(named_struct('start', 1.0D, 'end', 2.0D), named_struct('start', 3.0D, 'end', 4.0D))"
    df = spark.range(1).select(F.expr(spans).alias("s"), F.expr("array(0, 1, 2)").alias("n"), F.lit(20).cast("bigint").alias("frames"))
    row = df.select(
        A.inline_positions(F.col("s"), F.col("n")).alias("p"), A.marker_frames(A.inline_positions(F.col("s"), F.col("n")), F.col("frames"), 4).alias("m")
    ).first()
    assert row.p == [0.0, 2.5, 4.0]
    assert row.m == [0, 0, 10, 16, 20]


def test_fallback_shares_time_by_tokens(spark):
    df = spark.createDataFrame([(["one two", "?", "three"], 8.0)], "lines array<string>, d double")
    row = df.select(A.fallback_clauses(F.col("lines"), F.col("d")).alias("c")).select("c", A.fallback_words(F.col("c")).alias("w")).first()
    assert [(c.start, c.end) for c in row.c] == [(0.0, 4.0), (4.0, 6.0), (6.0, 8.0)]
    assert [w.text for w in row.w] == ["one", "two", "", "three"]


def test_decisions(spark):
    clause = "array<struct<text: string, start: double, end: double>>"
    schema = f"id int, lines array<string>, coarse {clause}, fine {clause}, words {clause}"
    both, split = [("a b c", 1.0, 2.0)], [("a b", 1.0, 1.5), ("c", 1.5, 2.0)]
    rows = [
        (1, ["a b", "c"], split, both, []),
        (2, ["a b", "c"], both, split, []),
        (3, ["a b", "c"], both, both, [("a", 1.0, 1.1)]),
        (4, ["a b", "c"], None, None, []),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r.decision for r in A.decide(df).collect()}
    assert got == {
        1: "transcription_exact_clause_match",
        2: "aligned_exact_clause_match",
        3: "aligned_word_matching",
        4: "fallback",
    }
    assert sorted(r.id for r in A.needs_fine_stage(df).collect()) == [2, 3]


@pytest.mark.parametrize("run", ["b c", "a b c d e f g h i j", "h i j", "c"])
def test_token_runs_against_brute_force(spark, run):
    texts = ["a b c d e f g h i j", "b c, B C!", "x", "c a b c d e f g h i j k"]
    left = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    right = spark.createDataFrame([(9, run), (8, run.upper()), (7, "zz")], "r int, text string")
    got = {tuple(r) for r in A.token_runs(left, "t", right, "r").collect()}
    want = set()
    needle = run.split()
    for t, text in enumerate(texts):
        words = [w.strip(",!").lower() for w in text.split()]
        for i in range(len(words) - len(needle) + 1):
            if words[i : i + len(needle)] == needle:
                want |= {(t, 9, i), (t, 8, i)}
    assert got == want
