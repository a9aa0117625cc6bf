"""Every query of the subpackage against its SQL on the smallest scale; the main test runs those without SQL as well."""

import pytest
from check import compare, duck

from cuesheet.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = duck(sf_dir).execute(ORACLE[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cursor.fetchall(), [d[0] for d in cursor.description]) is None


@pytest.mark.parametrize("name", ["op7_quality", "op8_decontamination"])
def test_native(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def rows_of(spark, sf_dir, name, table):
    return QUERIES[name](spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/{table}.parquet").collect()


def test_personal_data(spark, sf_dir):
    import hashlib

    from test_pii import brute

    from cuesheet.llm import pii

    got, docs = rows_of(spark, sf_dir, "op3_personal_data", "documents")
    texts = {r["doc_id"]: r["text"] for r in docs}
    assert len(got) == len(docs)
    for r in got:
        plain = brute(texts[r["doc_id"]])
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == n for _, k, _ in plain) for n in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_sharding(spark, sf_dir):
    import xxhash

    from cuesheet.llm import sharding

    got, docs = rows_of(spark, sf_dir, "op4_sharding", "documents")
    table = sharding.fill(sharding.names())
    for r in got:
        slot = xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), seed=42)
        slot = (slot - (1 << 64) if slot >= 1 << 63 else slot) % sharding.SLOTS
        assert (r["slot"], r["shard"]) == (slot, sharding.names()[table[slot]])
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)


def test_chat(spark, sf_dir):
    from test_chat import least

    got, turns = rows_of(spark, sf_dir, "op9_chat", "conversations")
    roles, costs = {}, {}
    for t in sorted(turns, key=lambda t: t["turn"]):
        roles.setdefault(t["conv_id"], []).append(t["role"])
    for r in got:
        costs[r["conv_id"]] = costs.get(r["conv_id"], 0) + r["cost"]
    assert len(got) == len(turns)
    assert costs == {conv: least(tuple(own)) for conv, own in roles.items()}


def test_pieces(spark, sf_dir):
    got, docs = rows_of(spark, sf_dir, "op10_pieces", "documents")
    from cuesheet.llm import pieces

    vocabulary = pieces.Vocabulary.load()
    texts = {r["doc_id"]: r["text"] for r in docs}
    assert len(got) == len(docs)
    assert all(r["lossless"] and vocabulary.decode(r["ids"]) == texts[r["doc_id"]] for r in got if texts[r["doc_id"]])


def test_quality_classifier(spark, sf_dir):
    got, docs = rows_of(spark, sf_dir, "op1_quality", "documents")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got)
    good = [r["kept"] for r in got if labels.get(r["doc_id"]) == 1]
    assert sum(good) >= 0.9 * len(good)
