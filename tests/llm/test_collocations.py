"""Collocations against counts over all phrases in one piece."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from cuesheet.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string"


def brute(rows, top=2000, least=100, percent=100):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        around = (
            b for (other, q), b in candidates.items()
            if other == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
        )
        if any(100 * b >= percent * a for b in around):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return sorted(ranked)


def found(spark, rows, **more):
    return sorted(tuple(r) for r in c.collocations(spark.createDataFrame(rows, SCHEMA), **more).collect())


def corpus(seed=4, docs=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Über", "ÄB", "x-y"]
    fixed = ["new york city", "at the end of the day", "w1 w2 w3 w1 w2"]
    rows = []
    for k in range(docs):
        parts = []
        for _ in range(rng.randrange(0, 60)):
            parts.append(rng.choice(fixed) if rng.random() < 0.2 else words[min(int(rng.expovariate(0.2)), 32)].upper())
            parts.append(rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " \x85 "]))
        rows.append((k, rng.choice(["en", "en", None, "und", "de"]), "".join(parts)))
    return rows


@pytest.mark.parametrize("budget", [1 << 20, 300, 20])
def test_against_brute_force(spark, budget):
    """Also with budgets so small that prefixes are extended to all lengths."""
    rows = corpus()
    got = found(spark, rows, least=12, budget=budget)
    assert got == brute(rows, least=12) and len(got) > 50


def test_top_and_percent(spark):
    rows = corpus(7)
    assert found(spark, rows, least=8, top=5, percent=60) == brute(rows, 5, 8, 60)


def test_odd_rows(spark):
    long = "a b c d e f " * 20_000
    rows = [(1, "en", None), (2, "en", ""), (3, None, " .. \t"), (4, "en", long), (4, "en", long), (None, "", "a b" + " , a b" * 120)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    names = SCHEMA + ", word string, f long, phrase string, size int, n long, grp long, hash long, slot int"
    rows = [(k, "en", "red apple. red pear. apple", "x", 1, "y", 2, 3, 4, 5, 6) for k in range(120)]
    got = c.collocations(spark.createDataFrame(rows, names)).collect()
    assert sorted(tuple(r) for r in got) == brute([r[:3] for r in rows])


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_001
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 6), ("en", "a b", 2, big - 9)], "lang string, phrase string, size int, f long")
    sizes = spark.createDataFrame([("en", 700_000_000_000_003)], "lang string, n long")
    (row,) = c.scored(phrases, sizes).collect()
    assert row["score"] == 1000 * (big - 9) * 700_000_000_000_003 // (big * (big + 6))


def test_groups_keep_to_the_budget():
    loads = np.random.default_rng(1).integers(0, 50, 1000)
    groups = c.pack_slots(loads, 100)
    totals = np.bincount(groups, loads)
    assert totals.max() <= 100 and len(totals) <= 2 * loads.sum() / 100 + 1 and (np.diff(groups) >= 0).all()


def test_prefixes_are_extended_until_they_fit(spark):
    rows = [(k, "en", " ".join(["the " + w for w in ("a", "b", "c", "d")] * 5)) for k in range(30)]
    texts = spark.createDataFrame(rows, SCHEMA).select("lang", "text")
    words = texts.mapInArrow(c._count_words, "lang string, word string, hash long, f long").groupBy("hash").sum("f")
    parts = c.divide(words.toDF("hash", "f"), texts, 200)
    assert len(parts.heavy) == 1 and len(parts.heavy[0]) == 1
