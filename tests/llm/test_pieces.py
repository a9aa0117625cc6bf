"""Sampled segmentations: every way's chance by brute force, reproducible draws, exact round trips."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cuesheet.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def small(scores, cuts=True):
    """A vocabulary of a few pieces and all bytes."""
    texts = list(scores)
    size = len(texts) + 256
    return pieces.Vocabulary(
        {t: k for k, t in enumerate(texts)},
        [*scores.values(), *[-5.0] * 256],
        [len(texts) + b for b in range(256)],
        [t.encode() for t in texts] + [bytes([b]) for b in range(256)],
        max(map(len, texts)),
        cuts,
    )


def all_ways(vocabulary, text):
    if not text:
        return [((), 0.0)]
    ways = []
    for piece, k in vocabulary.pieces.items():
        if text.startswith(piece):
            ways += [((k, *rest), vocabulary.scores[k] + s) for rest, s in all_ways(vocabulary, text[len(piece) :])]
    if text[0] not in vocabulary.pieces:
        ids = [vocabulary.byte_ids[b] for b in text[0].encode()]
        cost = sum(vocabulary.scores[k] for k in ids)
        ways += [((*ids, *rest), cost + s) for rest, s in all_ways(vocabulary, text[1:])]
    return ways


def test_chances_are_those_of_all_ways():
    v = small({" ": -1.0, "a": -1.0, "b": -1.2, "ab": -1.5, "aba": -2.0, " a": -1.7, "ba": -1.1, " ab": -2.2})
    ways = all_ways(v, " abaéab")
    temperature = 0.7
    weights = {w: math.exp(s / temperature) for w, s in ways}
    total = sum(weights.values())
    draws = 20_000
    got = pieces.sample(["abaéab"] * draws, pieces._mix(np.arange(draws, dtype=np.uint64)), pieces.Lattices(v, temperature))
    counts = Counter(tuple(g.tolist()) for g in got)
    assert set(counts) <= set(weights)
    for way, weight in weights.items():
        expected = draws * weight / total
        assert abs(counts[way] - expected) < 5 * math.sqrt(expected) + 5


def test_pieces_across_words():
    """A vocabulary whose pieces go on after a space is not cut at spaces."""
    v = small({" ": -1.0, "a": -1.0, "b": -1.0, "a b": -0.5}, cuts=False)
    got = {tuple(g.tolist()) for g in pieces.sample(["a b"] * 200, np.arange(200, dtype=np.uint64), pieces.Lattices(v, 1.0))}
    assert any(v.pieces["a b"] in g for g in got)


def test_round_trip(vocabulary):
    rng = random.Random(2)
    alphabet = list("abc  \n\t▁äß日🙂\x00​'.0") + ["the ", "ing", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["", " ", "x" * 5000, "日" * 3000, " ".join(f"w{k}" for k in range(20_000))]
    got = pieces.sample(texts, np.arange(len(texts), dtype=np.uint64), pieces.Lattices(vocabulary, 0.5))
    assert [vocabulary.decode(g.tolist()) if len(g) else "" for g in got] == texts


def test_batch_does_not_matter(vocabulary):
    texts = [f"The number {k} of some words, again and again" for k in range(50)]
    keys = pieces._mix(np.arange(50, dtype=np.uint64))
    whole = pieces.sample(texts, keys, pieces.Lattices(vocabulary, 0.5))
    alone = pieces.Lattices(vocabulary, 0.5)
    for k in reversed(range(50)):
        if k % 7 == 0:
            alone.reset()
        assert pieces.sample(texts[k : k + 1], keys[k : k + 1], alone)[0].tolist() == whole[k].tolist()


def test_dataframe(spark):
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (None, "Hello world", None), (1, "Hello world", 5), (4, "a▁b  c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = pieces.encode(df).collect()
    assert len(got) == 6 and all(r["lossless"] for r in got)
    assert len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == 1
    by = {r["doc_id"]: r for r in got}
    assert by[2]["ids"] is None and by[3]["ids"] == [] and by[2]["n_pieces"] == by[3]["n_pieces"] == 0
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(df)).collect()}
    assert back == {(i, t) for i, t, _ in rows}
    again = pieces.encode(df.repartition(3)).collect()
    assert Counter((r["doc_id"], str(r["ids"])) for r in got) == Counter((r["doc_id"], str(r["ids"])) for r in again)
    assert pieces.encode(df.limit(0)).count() == 0


def test_seed_and_temperature(spark):
    df = spark.createDataFrame([(k, "segmentations are sampled from everything") for k in range(100)], "doc_id long, text string")
    one = {r["doc_id"]: r["ids"] for r in pieces.encode(df, temperature=1.0, seed=1).collect()}
    other = {r["doc_id"]: r["ids"] for r in pieces.encode(df, temperature=1.0, seed=2).collect()}
    assert sum(one[k] != other[k] for k in one) > 50 and len({tuple(i) for i in one.values()}) > 5
    cold = pieces.encode(df, temperature=0.01).select("ids").distinct().count()
    assert cold == 1


def test_draws_close_to_one_stay_in_their_word(vocabulary, monkeypatch):
    """The largest number that can be drawn takes a word's last edges, however many nodes a worker remembers."""
    texts = [f"word{k} and others {k * 7919}" for k in range(40)]
    lattices = pieces.Lattices(vocabulary, 0.5)
    keys = np.arange(len(texts), dtype=np.uint64)
    monkeypatch.setattr(pieces, "uniform", lambda key, word, step: np.full(len(key), 1 - 2.0**-53))
    fresh = [g.tolist() for g in pieces.sample(texts, keys, lattices)]
    pieces.sample([" ".join(f"filler{k}" for k in range(s, s + 5000)) for s in range(0, 60_000, 5000)], np.arange(12, dtype=np.uint64), lattices)
    assert lattices.nodes > 500_000
    later = texts[::-1] + ["unseen words too"]
    got = pieces.sample(later, np.arange(len(later), dtype=np.uint64), lattices)
    assert [vocabulary.decode(g.tolist()) for g in got] == later
    assert [g.tolist() for g in got[:-1]] == fresh[::-1]
