"""Personal data in texts, also where it is disguised; all spans are in the source text's code points.

Plain identifiers (email, ip, card, phone) are found in the source text itself. Two transducers then rewrite the text
and remember for every character they emit which source characters it stands for: the first replaces homoglyphs
(look-alike letters, width and mathematical variants, digits of other scripts) and drops invisible characters; the
second rewrites spelled digits and written or bracketed "at" and "dot", each only inside an expression that reads as an
identifier. The same detectors run on the rewritten text, and what they find is mapped back. Plain findings always stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cuesheet.llm.arrow import slices

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind string, start int, end int, plain boolean>>"

# Each pattern can start only where a run starts, so that a failed run is not tried again from its middle.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")

# Look-alikes of Latin letters in the Cyrillic and Greek scripts, in pairs.
_CYRILLIC = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅУ", "aeopcyxijshdqwABEKMHOPCTXIJSY")
_GREEK = ("ανορυικτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "avopuiktxABEZHIKMNOPTYX")
_SIGNS = ("．。․＠﹫＋﹢－‐‑‒–−（）", "...@@++------()")
_INVISIBLE = "­​‌‍⁠﻿᠎‎‏"
# The digits' names in the four languages of the corpus, zero to nine.
_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT_OF = {name: str(k) for line in _NAMES for k, name in enumerate(line.split())} | {"oh": "0"}
# Endings that make an unbracketed "x at y dot z" an address.
_ENDINGS = "com org net edu gov mil int info biz io co ai app dev me tv uk us ca au de fr es it nl ch at be eu ru cn jp in br mx"

_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
# All repeats are bounded or possessive, so that no text makes a search quadratic.
_S = r"\s{0,2}"
_AT = rf"(?:{_S}{_OPEN}{_S}(?:at|@|arroba|arobase){_S}{_CLOSE}{_S})"
_DOT = rf"(?:{_S}{_OPEN}{_S}(?:dot|\.|punkt|punto|point){_S}{_CLOSE}{_S})"
_PART = r"[a-z0-9-]++"
_NAME = r"[a-z0-9_%+-]++"
_GAP = r"[^\S\n]{1,3}"
_WORD_AT, _WORD_DOT = rf"(?:{_GAP}at{_GAP})", rf"(?:{_GAP}dot{_GAP})"
#: Expressions with a bracketed sign, and expressions with words only and a known ending.
_ADDRESS = re.compile(
    rf"(?<![a-z0-9_%+-]){_NAME}(?:(?:\.|{_DOT}|{_WORD_DOT}){_NAME}){{0,8}}+"
    rf"(?:(?:{_AT}|\s?@\s?){_PART}(?:(?:\.|{_DOT}|{_WORD_DOT}|{_GAP}\.{_GAP}){_PART}){{0,8}}(?:\.|{_DOT}|{_WORD_DOT}|{_GAP}\.{_GAP})[a-z]{{2,24}}"
    rf"|{_WORD_AT}{_PART}(?:(?:\.|{_DOT}|{_WORD_DOT}){_PART}){{0,8}}(?:\.|{_DOT}|{_WORD_DOT})(?:{'|'.join(_ENDINGS.split())}))(?![a-z0-9-])"
)
_SIGN = re.compile(rf"(?P<at>{_AT}|{_WORD_AT}|\s?@\s?)|(?P<dot>{_DOT}|{_WORD_DOT}|{_GAP}\.{_GAP})")
_DIGIT_NAME = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_SPELLED = re.compile(
    rf"(?:(?:\bplus|\+)\s{{0,2}})?\b(?:{_DIGIT_NAME}|[0-9]++)\b(?:(?:[\s,-]{{1,3}}|\s?\.\s?|{_WORD_DOT}|\s?[()]\s?)\b(?:{_DIGIT_NAME}|[0-9]++)\b){{3,}}"
)
_SPELLED_PART = re.compile(rf"(?P<digit>\b{_DIGIT_NAME}\b)|(?P<plus>plus\s{{0,2}})|(?P<dot>{_WORD_DOT}|\s?\.\s?)|(?P<gap>[\s,()-]+)")
#: Every address holds one of these signs, whatever its dots look like.
_ANY_AT = re.compile(rf"@|{_OPEN}{_S}(?:at|arroba|arobase){_S}{_CLOSE}|{_WORD_AT}")
_ANY_NAME = re.compile(rf"\b{_DIGIT_NAME}\b")
_TWO_NAMES = re.compile(rf"\b{_DIGIT_NAME}[\s,.-]{{1,3}}{_DIGIT_NAME}\b")


def _luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        n = ord(digit) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the identifiers as they stand, by start, then kind."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        # The local part is the run of its characters before the sign, as far as no address has taken them.
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, 0, done))
        else:
            done = at + 1
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


@lru_cache(1)
def _glyphs() -> dict[int, str]:
    """What the first transducer writes for a code point: look-alikes, compatibility forms of ASCII, other digits."""
    table = {}
    for c in range(0x80, 0x1FBFA):
        if 0xD800 <= c < 0xE000:
            continue
        char = chr(c)
        form = unicodedata.normalize("NFKC", char)
        digit = unicodedata.decimal(char, None)
        if digit is not None:
            table[c] = str(digit)
        elif len(form) == 1 and form.isascii() and form.isalnum():
            table[c] = form
    for source, target in (_CYRILLIC, _GREEK, _SIGNS):
        table |= {ord(s): t for s, t in zip(source, target, strict=True)}
    return table | {ord(c): "" for c in _INVISIBLE}


@lru_cache(1)
def _is_glyph() -> np.ndarray:
    """For each code point whether the first transducer rewrites it."""
    found = np.zeros(0x110000, bool)
    found[list(_glyphs())] = True
    return found


class Rewritten:
    """A rewritten text with the source span of every character; built from left to right."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None):
        self.text, self.spans = text, spans  # no spans: every character stands for itself

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.spans is None else (self.spans[start][0], self.spans[end - 1][1])

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Disjoint edits (start, end, text) in order; what an edit writes stands for all that it replaces."""
        if not edits:
            return self
        text, spans, done = [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[done:start])
            spans.extend(((k, k + 1) for k in range(done, start)) if self.spans is None else self.spans[done:start])
            if new:
                text.append(new)
                spans.extend([self.source(start, end)] * len(new))
            done = end
        return Rewritten("".join(text), spans)


def _homoglyphs(text: str) -> Rewritten:
    if text.isascii():
        return Rewritten(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _glyphs()
    places = np.flatnonzero(_is_glyph()[points]).tolist()
    return Rewritten(text).replace([(k, k + 1, table[ord(text[k])]) for k in places])


def _spelled(lower: str) -> Iterator[tuple[int, int]]:
    """Where numbers hold a spelled digit.

    Names that stand apart are often words of the sentence ("call +1 (017) 555-7713 one day"), so such a number ends at
    an identifier that is plain; what lies between plain ones is searched on its own.
    """
    plain = None
    for m in _SPELLED.finditer(lower):
        if _TWO_NAMES.search(m.group()):
            yield m.span()
        elif _ANY_NAME.search(m.group()):
            if plain is None:
                plain, at = plain_spans(lower), 0
            while at < len(plain) and plain[at][2] <= m.start():
                at += 1
            start, k = m.start(), at
            while k < len(plain) and plain[k][0] < m.end():
                yield from _single_names(lower, start, plain[k][0])
                start = max(start, plain[k][2])
                k += 1
            yield from _single_names(lower, start, m.end())


def _single_names(lower: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _SPELLED.finditer(lower, start, end) if _ANY_NAME.search(m.group()))


def _undisguised(held: Rewritten) -> Rewritten:
    """The second transducer: addresses, then spelled numbers."""
    lower = _lower(held.text)
    if _ANY_AT.search(lower):
        edits = []
        for m in _ADDRESS.finditer(lower):
            for sign in _SIGN.finditer(lower, m.start(), m.end()):
                new = "@" if sign.lastgroup == "at" else "."
                if sign.group() != new:
                    edits.append((sign.start(), sign.end(), new))
        held = held.replace(edits)
        lower = _lower(held.text) if edits else lower
    if _ANY_NAME.search(lower):
        edits = []
        for start, end in _spelled(lower):
            for part in _SPELLED_PART.finditer(lower, start, end):
                kind = part.lastgroup
                new = _DIGIT_OF[part.group()] if kind == "digit" else {"plus": "+", "dot": ".", "gap": ""}[kind]
                if new != part.group():
                    edits.append((part.start(), part.end(), new))
        held = held.replace(edits)
    return held


def _lower(text: str) -> str:
    lower = text.lower()
    # A few letters get longer in lower case; places would no longer fit.
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, plain) of all findings by start, then kind; null and empty texts have none."""
    if not text:
        return []
    plain = plain_spans(text)
    held = _undisguised(_homoglyphs(text))
    found = [(s, k, e, True) for s, k, e in plain]
    if held.spans is not None:
        for start, kind, end in plain_spans(held.text):
            source = held.source(start, end)
            if text[source[0] : source[1]] == held.text[start:end]:
                continue  # nothing in it was disguised: the first search decides
            if not any(k == kind and s <= source[0] and source[1] <= e for s, k, e in plain):
                found.append((source[0], kind, source[1], False))
        found.sort()
    return found


def find(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id and spans, an array of (kind, start, end, plain) by start and kind.

    Ends are exclusive, places are code points of the source text. Null and empty texts have no spans; rows that
    repeat give repeated results; further columns are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [
                [{"kind": KINDS[k], "start": s, "end": e, "plain": p} for s, k, e, p in spans(text)]
                for text in part.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id long, spans {SPAN}")


def listed(found: Column) -> Column:
    """An array of spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the plain spans by kind, their digest, the list of all spans, and the number of disguised ones."""

    def count(kind: str) -> Column:
        own = F.filter("spans", lambda s: s["plain"] & (s["kind"] == kind))
        return F.size(own).cast("bigint").alias(f"n_{kind}")

    plain = F.filter("spans", lambda s: s["plain"])
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(listed(plain), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(plain)).cast("bigint").alias("n_disguised"),
    )


def masked(text: str) -> str:
    """The text with every finding replaced by its kind in angle brackets; findings that overlap become one."""
    parts, done = [], 0
    for start, kind, end, _ in spans(text):
        if start >= done:
            parts += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if parts else text


def redact(documents: DataFrame) -> DataFrame:
    """The same rows and columns with findings masked in ``text``; an n_chars column gets the new length."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            new = [masked(t) if t else t for t in part.column(at).to_pylist()]
            columns = [pa.array(new, pa.string()) if k == at else c for k, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in documents.schema])
    done = documents.mapInArrow(run, schema)
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(schema["n_chars"].dataType))
    return done
