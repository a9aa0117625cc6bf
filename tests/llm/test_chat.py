"""Role repair: least costs by trying everything, cuts at any place, rendering by hand."""

import functools
import itertools
import random

import pytest

from cuesheet.llm import chat


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) and (roles or True)


@functools.cache
def least(roles):
    """The least cost by trying all target roles, merges and insertions; empty turns go where legality asks for them."""
    best = None
    for targets in itertools.product(range(3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            cost, state, ok = 0, 0, True
            for role, target, merge in zip(roles, targets, merges):
                source = chat.ROLES.index(role) if role in chat.ROLES else -1
                cost += 0 if source == target else chat.UNKNOWN if source < 0 else chat.RELABEL
                if merge:
                    ok &= state == target + 1
                    cost += chat.MERGE
                else:
                    # The shortest legal filling between the two turns.
                    ok &= not (target == 0 and state > 0)
                    needs = {(0, 2), (1, 2), (2, 1), (3, 2)}
                    cost += chat.INSERT * ((state, target) in needs)
                state = target + 1
            cost += chat.INSERT * {0: 0, 1: 2, 2: 1, 3: 0}[state]
            if ok and (best is None or cost < best):
                best = cost
    return best


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, state int")
    return chat.repair(df)


def test_against_trying_everything(spark):
    rng = random.Random(8)
    rows, convs = [], {}
    for conv in range(60):
        roles = [rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None]) for _ in range(rng.randrange(1, 6))]
        convs[conv] = roles
        rows += [(conv, k, role, f"c{conv}t{k}") for k, role in enumerate(roles)]
    rng.shuffle(rows)
    got = run(spark, rows).collect()
    assert len(got) == len(rows)
    for conv, roles in convs.items():
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["turn"])
        assert [r["role"] for r in own] == roles
        assert sum(r["cost"] for r in own) == least(tuple(roles))
        text = "".join(r["piece"] for r in own)
        turns = [t.split("\n", 1) for t in text.split(chat.OPEN)[1:]]
        assert legal([t[0] for t in turns]) and all(t[1].endswith(chat.CLOSE) for t in turns)
        assert [x for t in turns for x in t[1].removesuffix(chat.CLOSE).split("\n") if x] == [f"c{conv}t{k}" for k in range(len(roles))]


def test_cuts_do_not_matter(spark, monkeypatch):
    """One conversation holds most rows; chunks of 3 rows, and other numbers of tasks, give what one chunk gives."""
    rng = random.Random(1)
    rows = [(7, k, rng.choice(["user", "assistant", "system", "other"]), f"t{k}") for k in range(300)]
    rows += [(k % 5, k, rng.choice(["user", "assistant"]), None) for k in range(60)]
    whole = sorted(map(str, run(spark, rows).coalesce(1).collect()))
    monkeypatch.setattr(chat, "CHUNK", 3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(map(str, run(spark, rows).collect())) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rendering(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", None), (2, 0, "system", "s")]
    got = {(r["conv_id"], r["turn"]): r for r in run(spark, rows).collect()}
    one = "".join(got[1, k]["piece"] for k in range(4))
    assert one == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\nc\n<|im_end|>\n"
    assert [got[1, k]["action"] for k in range(4)] == ["keep", "merge", "keep", "merge"]
    two = got[2, 0]
    assert two["new_role"] in ("user", "system", "assistant") and two["cost"] == least(("system",))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "x"), (None, None, None, None), (3, 1, "user", "x" * 200_000), (3, 1, "user", "x" * 200_000),
        (3, 1, "assistant", ""), (4, None, "assistant", "y"),
    ]
    got = run(spark, rows).collect()
    assert len(got) == len(rows) and {r["conv_id"] for r in got} == {None, 3, 4}
    assert all(r["new_role"] in chat.ROLES and r["piece"] for r in got)
    assert run(spark, []).count() == 0


@pytest.mark.parametrize("roles", [["user", "assistant"], ["system", "user", "assistant", "user", "assistant"]])
def test_legal_sequences_stay(spark, roles):
    got = run(spark, [(1, k, r, "t") for k, r in enumerate(roles)]).collect()
    assert all(r["action"] == "keep" and r["cost"] == 0 and r["inserted"] == 0 for r in got)


def test_matrices_agree_with_tracing():
    rng = random.Random(3)
    for _ in range(100):
        roles = [rng.choice(["system", "user", "assistant", "x"]) for _ in range(rng.randrange(1, 9))]
        matrix = chat._all(chat.steps(r) for r in roles)
        _, costs = chat._forward(roles, [0, chat._FAR, chat._FAR, chat._FAR])
        assert costs == matrix[0]
