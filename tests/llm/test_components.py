"""Components of links, and the number of rounds they take."""

import random

from cuesheet.llm.components import contract


def labels(spark, pairs, rounds=None):
    edges = spark.createDataFrame(pairs, "a long, b long")
    return {r["node"]: r["component"] for r in contract(edges, rounds=rounds).collect()}


def test_ascending_path_takes_few_rounds(spark):
    rounds = []
    got = labels(spark, [(k, k + 1) for k in range(10_000)], rounds)
    assert got == {k: 0 for k in range(10_001)}
    assert len(rounds) <= 20


def test_random_graph(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(300) * 5 - 400, rng.randrange(300) * 5 - 400) for _ in range(220)]
    low = {x: x for pair in pairs for x in pair if pair[0] != pair[1]}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in pairs:
        if a != b:
            one, other = sorted((root(a), root(b)))
            low[other] = one
    assert labels(spark, pairs) == {x: root(x) for x in low}


def test_star_loop_null_and_empty(spark):
    assert labels(spark, [(5, k) for k in range(50, 90)] + [(5, 5), (7, 7), (None, 3), (3, None)]) == {k: 5 for k in [5, *range(50, 90)]}
    assert labels(spark, []) == {}
