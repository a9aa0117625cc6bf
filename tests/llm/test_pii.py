"""Identifiers by position: plain ones against the patterns as they are written, disguised ones by example."""

import hashlib
import random
import re

import pytest

from cuesheet.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def brute(text):
    rows = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m.group().split(".")),
                12 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if good:
                rows.append((m.start(), kind, m.end()))
    return sorted(rows)


def test_plain_against_patterns():
    rng = random.Random(11)
    parts = list("ab._%+-@@..019 ()\n") + ["4736962573099581", "x@y.de", "+1 (017) 555-7713", "10.0.0.256", "255.1.2.3", "ä"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert pii.plain_spans(text) == brute(text), text


@pytest.mark.parametrize(
    "text, kind, source",
    [
        ("write to john dot smith at example dot com please", "email", "john dot smith at example dot com"),
        ("mail: jane(at)mail[dot]example{dot}org now", "email", "jane(at)mail[dot]example{dot}org"),
        ("b @ c . org", "email", "b @ c . org"),
        ("uѕer@exаmple.com", "email", "uѕer@exаmple.com"),
        ("ｊｏｈｎ＠ｅｘ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘ．ｃｏｍ"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven"),
        ("ip one nine two dot one six eight dot one dot one x", "ip", "one nine two dot one six eight dot one dot one"),
        ("４７３６ ９６２５ ７３０９ ９５８１", "card", "４７３６ ９６２５ ７３０９ ９５８１"),
    ],
)
def test_disguised(text, kind, source):
    spans = [(pii.KINDS[k], text[s:e]) for s, k, e, plain in pii.spans(text) if not plain]
    assert (kind, source) in spans


@pytest.mark.parametrize(
    "text, source",
    [
        ("write to jane.doe at gmail.com today", "jane.doe at gmail.com"),
        ("mail x at y.com", "x at y.com"),
        ("x\tat  mail.y.org!", "x\tat  mail.y.org"),
    ],
)
def test_written_at_with_plain_dots(text, source):
    """The span is the same whatever else the text holds."""
    for rest in ("", " An anecdote.", " @", " (at)"):
        found = [(pii.KINDS[k], (text + rest)[s:e]) for s, k, e, _ in pii.spans(text + rest)]
        assert found == [("email", source)]
    assert pii.masked(text) == text.replace(source, "<EMAIL>")


@pytest.mark.parametrize(
    "kind, source",
    [
        ("ip", "eight dot eight dot eight dot eight"),
        ("ip", "10.0.zero.1"),
        ("phone", "plus 1 five 5 five 0 one 2 three 4 seven"),
        ("card", "four 7 three 6 nine 6 two 5 seven 3 zero 9 nine 5 eight 1"),
    ],
)
def test_digit_names_apart(kind, source):
    for text in (source, f"x {source} y", f"at 10.0.0.1, {source}."):
        found = [(pii.KINDS[k], text[s:e]) for s, k, e, plain in pii.spans(text) if not plain]
        assert found == [(kind, source)], text


@pytest.mark.parametrize("text", ["+1 (017) 555-7713 one day", "10.0.0.1 one", "un 4736962573099581 un ami", "one, 10.0.0.1, 10.0.0.2 six"])
def test_words_beside_plain_findings(text):
    found = pii.spans(text)
    assert found and all(plain for *_, plain in found)


@pytest.mark.parametrize(
    "text",
    [
        "we looked at the dot on the map at noon", "meet me at home dot", "one two three", "der Punkt am Ende (at)",
        "Das ist öffentlich; élève à six heures", "a dot b dot c", "12 monkeys, 7 samurai, 3 amigos",
    ],
)
def test_clean_text_has_nothing(text):
    assert pii.spans(text) == [] and pii.masked(text) == text


def test_plain_findings_stay():
    text = "real x@y.com and z (at) y (dot) com, +1 (017) 555-7713"
    spans = pii.spans(text)
    assert [(s, k, e) for s, k, e, plain in spans if plain] == brute(text)
    assert len([1 for *_, plain in spans if not plain]) == 1
    assert pii.masked(text) == "real <EMAIL> and <EMAIL>, <PHONE>"


def test_long_texts_are_linear():
    for text in ("a." * 60_000 + "@", " " * 100_000 + "dot @", "one " * 40_000, "1 " * 60_000 + "dot", "(" * 60_000 + "@"):
        pii.spans(text)


def test_long_mixed_numbers_are_linear():
    for text in ("one 1 " * 30_000, "10.0.0.1 one 5, " * 10_000, "one 10.0.0.1 1 " * 10_000, "8 dot " * 20_000 + "one"):
        pii.spans(text)


def test_query_columns(spark):
    rows = [(1, "x@y.com 10.0.0.1", "k"), (2, None, None), (3, "", "k"), (None, "x (at) y (dot) com", "k"), (1, "x@y.com 10.0.0.1", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    assert pii.find(df).count() == 5
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["spans"]) == (1, 1, "email:0:7,ip:8:16")
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:0:7,ip:8:16").hexdigest()
    assert got[2]["spans"] == got[3]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[None]["n_email"], got[None]["n_disguised"], got[None]["spans"]) == (0, 1, "email:0:18")


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a x@y.com", "en", 9), (2, None, None, None)], "doc_id long, text string, kind string, n_chars long")
    got = pii.redact(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "a <EMAIL>", "en", 9), (2, None, None, None)]
    assert pii.redact(df.limit(0)).count() == 0
