"""Near duplicates against brute force, on sets of words that are planted to be close to the limit."""

import itertools
import random

from pyspark.sql import functions as F

from cuesheet.llm import minhash

SCHEMA = "doc_id long, text string, source string"


def brute(rows):
    def grams(text):
        found = minhash.words(text)
        if not found:
            return set()
        width = min(5, len(found))
        return {tuple(found[k : k + width]) for k in range(len(found) - width + 1)}

    sets = [(i, grams(t)) for i, t, *_ in rows]
    low = {i: i for i, _ in sets if i is not None}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
            one, other = sorted((root(a), root(b)))
            low[other] = one
    return sorted(
        ((i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets), key=str
    )


def found(spark, rows):
    df = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 200]))]
        for copy in range(rng.choice([1, 2, 9])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text), "s"))
    rows += [(1000 + k, rows[0][1].upper(), None) for k in range(30)]  # a group of exact copies in other case
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_chain_of_links(spark):
    """Each text is close to the next one only, so the component needs several steps."""
    words = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(12):
        rows.append((50 - k, " ".join(words[3 * k : 3 * k + 40] + [f"x{j}" for j in range(3 * k, 3 * k)]), "s"))
    rows = [(i, t, s) for i, t, s in rows if t]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"z{k}" for k in range(30_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (4, "one two", "a"), (5, "ONE  two", "a"), (6, "one", "a"),
        (None, "one two", "a"), (None, None, "a"), (7, long, "a"), (8, long + " end", None), (9, "one two", "a"),
        (9, "one two", "a"), (11, "äöü ÄÖÜ", None), (12, "äöü äöü", None),
    ]
    assert found(spark, rows) == brute(rows)


def test_same_id_links_its_texts(spark):
    rows = [(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (2, "k l m n o p", "s"), (3, "k l m n o p", "s")]
    assert {r[2] for r in found(spark, rows)} == {1}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_clashing_columns(spark):
    names = "doc_id long, text string, bucket long, rep long, component long, codes string, print string"
    df = spark.createDataFrame([(1, "a b c", 5, 5, 5, "x", "y"), (2, "a b c", 6, 6, 6, "x", "y")], names)
    assert sorted(r["component_id"] for r in minhash.near_duplicates(df).collect()) == [1, 1]


def test_signature_is_a_similarity():
    """The share of equal coordinates estimates the Jaccard similarity."""
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(400 * share)
            one = np.concatenate([both[:n], both[n : n + (400 - n) // 2]])
            other = np.concatenate([both[:n], both[n + (400 - n) // 2 :]])
            errors.append((minhash.signature(one) == minhash.signature(other)).mean() - n / 400)
        assert abs(np.mean(errors)) < 0.03


def test_one_large_bucket_group(spark):
    """Many different texts that are all alike: verified against one, never all with all."""
    base = [f"b{k}" for k in range(300)]
    rows = [(k, " ".join(base[:k % 290] + [f"own{k}"] + base[k % 290 + 1 :]), "s") for k in range(300)]
    got = found(spark, rows)
    assert {r[2] for r in got} == {0} and sum(r[3] for r in got) == 1


def test_hot_group_by_query(spark, sf_dir):
    from cuesheet.llm.queries import QUERIES

    df = QUERIES["op2_minhash"](spark, sf_dir)
    assert df.where(F.col("kept") & (F.col("doc_id") != F.col("component_id"))).count() == 0


def test_large_open_bucket(spark, monkeypatch):
    """A family that drifts apart: far members meet the others in cells, and no link is lost."""
    monkeypatch.setattr(minhash, "SMALL", 3)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    family = [base]
    for k in range(90):
        text = list(rng.choice(family[-12:] if k % 2 else family))
        for _ in range(rng.choice([1, 2, 4, 7])):
            text[rng.randrange(len(text))] = f"n{k}x{rng.randrange(99)}"
        family.append(text)
    order = list(range(len(family)))
    rng.shuffle(order)
    rows = [(i, " ".join(t), "s") for i, t in zip(order, family)]
    expected = brute(rows)
    assert 1 < len({r[2] for r in expected}) < 80
    assert found(spark, rows) == expected


def drifting(count, step, rng):
    """Revisions of one page: each differs from the one before by a few words, ids ascend."""
    text, rows = [f"b{k}" for k in range(120)], []
    for k in range(count):
        text = list(text)
        for _ in range(step):
            text[rng.randrange(len(text))] = f"n{k}x{rng.randrange(99)}"
        rows.append((k, " ".join(text), "s"))
    return rows


def test_ascending_revisions(spark):
    rows = drifting(120, 1, random.Random(4))
    assert found(spark, rows) == brute(rows)


def test_several_texts_of_one_id_in_a_large_open_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    rng = random.Random(6)
    rows = [(i // 2, t, s) for i, t, s in drifting(60, 4, rng)] + [(i // 2 + 40, t, s) for i, t, s in drifting(60, 3, rng)]
    rng.shuffle(rows)
    # Both texts of an id make one node.
    sets = {}
    for i, t, _ in rows:
        sets.setdefault(i, []).append(set(zip(*[minhash.words(t)[k:] for k in range(5)])))
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(4 * len(x & y) >= 3 * len(x | y) for x in sets[a] for y in sets[b]):
            one, other = sorted((root(a), root(b)))
            low[other] = one
    assert {(r[0], r[2]) for r in found(spark, rows)} == {(i, root(i)) for i in sets}


def test_rows_of_an_open_bucket_grow_in_proportion(spark):
    """A large component and a few classes beside it: twice the classes make twice the pairs, none inside it."""

    def candidates(size):
        prefixes = []
        for k in range(size):
            component = k + 1 if k < 5 else 9
            prefixes += [(k, component, 100, code, 1 + code) for code in range(4)]
        df = spark.createDataFrame(prefixes, "rep long, component long, n long, code long, at long")
        return minhash._crossing(df).count()

    assert candidates(400) == 5 * 395 + 10 and candidates(800) == 5 * 795 + 10
