"""SimHash near duplicates against brute force over all pairs."""

import itertools
import random

import pytest
import xxhash

from cuesheet.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split(" ") if w]
    width = min(3, len(words))
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(ids_and_prints):
    low = {i: i for i, _ in ids_and_prints if i is not None}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    known = [(i, p) for i, p in ids_and_prints if i is not None]
    for (a, x), (b, y) in itertools.combinations(known, 2):
        if (x ^ y).bit_count() <= 2 or a == b:
            one, other = sorted((root(a), root(b)))
            low[other] = one
    return {i: root(i) for i in low}


def found(spark, rows):
    df = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    label = components(prints)
    return sorted(((i, f"{p:016x}", label.get(i)) for i, p in prints), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 8])):
            text = list(base)
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = rng.choice(vocabulary).upper()
            rows.append((len(rows), "  ".join(text)))
    rng.shuffle(rows)
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    long = " ".join(f"z{k % 977}" for k in range(100_000))
    rows = [
        (1, None), (2, ""), (3, " \t "), (None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (5, "A  B\tC"),
        (6, "a b"), (7, long), (8, long + " end"), (9, "käse größe été"), (4, "x y z x y"), (10, "x y z x y"),
    ]
    got = found(spark, rows)
    assert got == expected(rows)
    assert {r[2] for r in got if r[0] in (1, 2, 3)} == {1} and {r[2] for r in got if r[0] in (4, 10)} == {4}


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    names = "doc_id long, text string, print long, bucket long, k int, component string, members long"
    df = spark.createDataFrame([(1, "a b c", 1, 1, 1, "x", 1), (2, "a b c", 2, 2, 2, "y", 2)], names)
    assert sorted(r["component_id"] for r in simhash.near_duplicates(df).collect()) == [1, 1]


def linked(spark, prints):
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    from cuesheet.llm.components import contract

    label = {r["node"]: r["component"] for r in contract(simhash.links(df)).collect()}
    return [label.get(p - (1 << 64) if p >> 63 else p, p - (1 << 64) if p >> 63 else p) for p in prints]


@pytest.mark.parametrize("small", [0, 3, 16, 10**6])
def test_links_whatever_the_bucket_limit(spark, monkeypatch, small):
    """Clouds of fingerprints around centres: pairs only, centres only, and both give the same components."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(11)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 5, 60])):
            value = centre
            for _ in range(rng.choice([0, 1, 2, 2, 3, 5])):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    prints = sorted(prints)
    got = linked(spark, prints)
    label = components([(k, p) for k, p in enumerate(prints)])
    pairs = {}
    assert all(pairs.setdefault(label[k], got[k]) == got[k] for k in range(len(prints)))
    assert len(set(label.values())) == len(set(got)) > 12


def test_rows_stay_in_proportion_to_a_hot_bucket(spark):
    """All values of 10 bits in one place share buckets; links are as many as members times their bits, not pairs."""
    rng = random.Random(2)
    high = rng.getrandbits(32) << 32
    prints = sorted({high | rng.getrandbits(14) for _ in range(4000)})
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    assert simhash.links(df).count() <= 66 * len(prints)
