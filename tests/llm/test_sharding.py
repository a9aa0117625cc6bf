"""The lookup table against a plain filling by turns, and what it promises."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import sharding


def brute(shards, slots):
    orders = []
    for name in shards:
        start, stride = sharding.preferences(name, slots)
        orders.append([(start + k * stride) % slots for k in range(slots)])
    table = {}
    while len(table) < slots:
        for k, order in enumerate(orders):
            if len(table) < slots:
                table[next(s for s in order if s not in table)] = k
    return [table[s] for s in range(slots)]


@pytest.mark.parametrize("count, slots", [(1, 3), (3, 7), (5, 101), (7, 7)])
def test_against_plain_filling(count, slots):
    names = sharding.names(count)
    assert sharding.fill(names, slots).tolist() == brute(names, slots)


def test_even_and_stable():
    names = sharding.names(64)
    table = sharding.fill(names)
    sizes = Counter(table.tolist())
    assert len(sizes) == 64 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill([n for n in names if n != names[10]])
    kept = [n for k, n in enumerate(names) if k != 10]
    moved = sum(1 for a, b in zip(table, fewer) if a != 10 and names[a] != kept[b])
    assert moved < 0.06 * len(table)


def test_bad_parameters():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (sharding.names(11), 7)):
        with pytest.raises(ValueError):
            sharding.fill(shards, slots)


def test_place(spark):
    rows = [(k % 50, "t" * (k % 3), "old", 7) for k in range(200)] + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    placed = sharding.place(df, ["doc_id"], sharding.names(5), 101)
    assert placed.count() == 202 and "old" not in {r["shard"] for r in placed.collect()}
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n <> 1").count() == 0
    assert "Exchange hashpartitioning" not in placed._jdf.queryExecution().executedPlan().toString()
    assert sharding.place(df.limit(0), ["doc_id"], ["a"], 3).count() == 0


def test_write(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "doc_id")
    sharding.write(df, ["doc_id"], sharding.names(4), f"{tmp_path}/out", 101)
    back = spark.read.parquet(f"{tmp_path}/out")
    again = sharding.place(df, ["doc_id"], sharding.names(4), 101)
    assert sorted((r["doc_id"], r["shard"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"]) for r in again.collect())
