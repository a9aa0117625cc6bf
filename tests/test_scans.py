"""Chunked scans against plain windows, with one key that holds most rows."""

import random

from pyspark.sql import Window, functions as F

from cuesheet.operators.scans import Running, attach, chunk_of, global_position, running


def _rows(spark):
    rng = random.Random(7)
    rows = [("hot", i, rng.randint(-5, 9), rng.choice([None, i])) for i in range(400)]
    rows += [(f"k{k}", i * 3, rng.randint(-5, 9), rng.choice([None, None, i])) for k in range(20) for i in range(5)]
    return spark.createDataFrame(rows, "k string, idx bigint, v bigint, mark bigint")


def test_running_measures_equal_windows(spark):
    rows = _rows(spark)
    got = running(
        rows,
        ["k"],
        ["idx"],
        [
            Running("before", "sum", F.col("v")),
            Running("upto", "sum", F.col("v"), True),
            Running("top", "max", F.col("v")),
            Running("prev", "last", F.col("mark")),
            Running("next", "next", F.col("mark")),
            Running("all", "total", F.col("v")),
        ],
        chunk_of("idx", 16),
    )
    order = Window.partitionBy("k").orderBy("idx")
    past, now = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*",
        F.coalesce(F.sum("v").over(past), F.lit(0)).alias("before"),
        F.sum("v").over(now).alias("upto"),
        F.max("v").over(past).alias("top"),
        F.last("mark", True).over(past).alias("prev"),
        F.first("mark", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        F.sum("v").over(Window.partitionBy("k")).alias("all"),
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rows_never_gather_by_key_alone(spark):
    plan = running(_rows(spark), ["k"], ["idx"], [Running("s", "sum", F.col("v"))], chunk_of("idx", 16))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window" in line]
    # One window over the chunk table, one inside the chunks.
    assert len(windows) == 2
    assert any("_chunk" in line.split("windowspecdefinition(")[1].split("ASC")[0].split(",")[1] for line in windows)


def test_attach_and_position(spark):
    rows = _rows(spark)
    facts = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, w int")
    assert attach(rows, facts, ["k"], chunk_of("idx", 16)).count() == 405
    kept = attach(rows, facts, ["k"], chunk_of("idx", 16), "left")
    assert kept.count() == rows.count() and kept.where("w is null").count() == 95
    ints = rows.withColumn("g", F.when(F.col("k") == "hot", 5).otherwise(F.crc32("k") % 1000).cast("bigint"))
    flat = global_position(ints.select("g", "idx", "k"), "g", ["idx", "k"])
    want = sorted((r.g, r.idx, r.k) for r in ints.collect())
    got = [(r.g, r.idx, r.k) for r in sorted(flat.collect(), key=lambda r: r.position)]
    assert got == want
    assert [r.position for r in sorted(flat.collect(), key=lambda r: r.position)] == list(range(len(want)))


def test_positions_of_spread_out_ids(spark):
    """Hashed ids of 62 bits: no window over more rows than tasks, and positions as a global sort gives them."""
    rng = random.Random(3)
    ids = [rng.getrandbits(62) - (1 << 61) for _ in range(3000)] + [7] * 20
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id bigint, k bigint").repartition(6)
    got = sorted((r.position, r.id, r.k) for r in global_position(df, "id", ["k"]).collect())
    assert got == [(n, i, k) for n, (i, k) in enumerate(sorted((i, k) for k, i in enumerate(ids)))]
    assert global_position(df.limit(0), "id", ["k"]).count() == 0
