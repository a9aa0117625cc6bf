"""Benchmark windows in documents against a search by hand."""

import hashlib
import random
import re

from cuesheet.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, benchmark):
    items = [(i, words(t)) for i, t in benchmark]
    rows = []
    for doc_id, text in documents:
        w = words(text)
        hit, held = set(), set()
        for item, own in items:
            size = min(10, len(own))
            for s in range(len(own) - size + 1 if own else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == own[s : s + size]:
                        hit.update(range(at, at + size))
                        held.add(item)
        names = sorted(str(i) for i in held if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        rows.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(rows, key=str)


def found(spark, documents, benchmark):
    docs = spark.createDataFrame([(*d, "x", "y") for d in documents], "doc_id long, text string, window string, row string")
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    return sorted((tuple(r) for r in decontaminate.contamination(docs, items).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)]
    benchmark = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 10, 11, 25])))) for k in range(12)]
    documents = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 30, 80]))]
        if k % 3 == 0:
            own = benchmark[rng.randrange(12)][1].split()
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        documents.append((k, rng.choice([" ", ", ", "\n", "--"]).join(text).replace("w1", "W1")))
    assert found(spark, documents, benchmark) == brute(documents, benchmark)


def test_overlap_and_repeats(spark):
    item = " ".join(f"k{n}" for n in range(14))
    documents = [
        (1, item), (2, item + " " + item), (2, item + " " + item), (3, item.replace("k13", "")),
        (4, " ".join(item.split()[:9])), (5, "x " + item + " y"), (6, None), (7, ""), (None, item),
        (8, " ".join(["k0"] * 50_000) + " " + item),
    ]
    benchmark = [(1, item), (2, item), (2, item), (None, item), (3, None), (4, "..."), (50, "K2 k3")]
    assert found(spark, documents, benchmark) == brute(documents, benchmark)


def test_words_beyond_ascii(spark):
    item = "Über die Straße_geht ein Bär É é 東京 ñ ja"
    documents = [(1, "x " + item.replace(" ", " - ")), (2, item.lower()), (3, item)]
    assert found(spark, documents, [(1, item)]) == brute(documents, [(1, item)])


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")]) == []
    assert found(spark, [(1, "a b c")], []) == brute([(1, "a b c")], [])


def test_lookup_tables_of_any_size(spark, monkeypatch):
    """Beyond the size that is broadcast, words do not travel with every shingle, and the rows are the same."""
    item = " ".join(f"k{n}" for n in range(14))
    documents = [(1, item), (2, item + " " + item), (2, "x"), (3, item.replace("k13", "")), (5, "x " + item + " y"), (6, None), (None, item)]
    documents += [(8, " ".join(["k0"] * 20_000) + " " + item), (9, "k12 k13"), (10, "k2")]
    benchmark = [(1, item), (2, item), (None, item), (3, None), (50, "K2 k3"), (51, "k13"), (52, "k0 k0 k0 k1 k2")]
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    monkeypatch.setattr(decontaminate, "_sized", lambda table: table)
    assert found(spark, documents, benchmark) == brute(documents, benchmark)
    assert found(spark, documents, []) == brute(documents, [])
    assert found(spark, [], benchmark) == []
