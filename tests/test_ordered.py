"""Segmented scans against plain loops, with segments far shorter than the groups and one hot group."""

import random

import pytest
from pyspark.sql import functions as F

from loomstone.plans.ordered import Edge, Mark, history, position_bucket, scan


def rows():
    rng = random.Random(5)
    out = []
    for key, n in (("hot", 90), ("a", 1), ("b", 7), ("c", 3)):
        pos = 0
        for _ in range(n):
            pos += rng.choice([1, 1, 2, 9])
            out.append((key, pos, rng.randint(0, 3), rng.choice([None, "x", "y"])))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("levels", "fan"), [(0, 65_536), (1, 3), (2, 3), (3, 2)])
def test_scan(spark, levels, fan):
    data = rows()
    df = spark.createDataFrame(data, "k string, pos long, n int, s string")
    got = scan(
        df, ["k"], ["pos"], position_bucket("pos", 4),
        sums={"total": F.col("n").cast("long")},
        lasts={"last": F.col("s")},
        marks={"at_x": Mark("total", F.col("s") == "x"), "first_x": Mark("total", F.col("s") == "x", first=True)},
        edges={"changes": Edge(["n"], lambda now, before: ~before("n").eqNullSafe(now("n")))},
        nexts={"next": "s"}, prevs={"prev": "n"}, levels=levels, fan=fan,
    )
    got = {(r["k"], r["pos"]): r for r in got.collect()}
    assert len(got) == len(data)
    for key in {d[0] for d in data}:
        group = sorted(d for d in data if d[0] == key)
        total, last, at_x, first_x, changes, prev = 0, None, None, None, 0, None
        for i, (_, pos, n, s) in enumerate(group):
            total += n
            last = s if s is not None else last
            if s == "x":
                at_x = total
                first_x = total if first_x is None else first_x
            changes += n != prev
            r = got[(key, pos)]
            after = group[i + 1][3] if i + 1 < len(group) else None
            assert (r["total"], r["last"], r["at_x"], r["first_x"], r["changes"]) == (total, last, at_x, first_x, changes)
            assert (r["next"], r["prev"]) == (after, prev)
            prev = n


def test_history(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, pos long, n int, s string")
    got = {(r["k"], r["pos"]): r["h"] for r in history(df, ["k"], ["pos"], position_bucket("pos", 3), "n", 3, "h").collect()}
    for key in {d[0] for d in data}:
        group = sorted(d for d in data if d[0] == key)
        for i, (_, pos, *_rest) in enumerate(group):
            assert got[(key, pos)] == [g[2] for g in group[max(0, i - 3) : i]]


def test_scan_shuffles_rows_once(spark):
    df = spark.createDataFrame(rows(), "k string, pos long, n int, s string")
    out = scan(df, ["k"], ["pos"], position_bucket("pos", 4), sums={"total": F.col("n").cast("long")}, lasts={"last": F.col("s")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 4


def test_sparse_positions_leave_no_window_over_a_whole_group(spark):
    """A group whose every row is a segment: the windows over summaries go by group and bucket, and the top one is short."""
    fan = 64
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 100_003).alias("pos"), F.lit(1).alias("n"))
    out = scan(df, ["k"], ["pos"], position_bucket("pos", 4096), sums={"total": F.col("n").cast("long")}, prevs={"prev": "pos"}, levels=2, fan=fan)
    assert out.where("total <> (pos DIV 100003) + 1 OR NOT prev <=> nullif(pos, 0) - 100003").count() == 0
    seg = df.select(F.floor(F.col("pos") / 4096).alias("s"))
    sizes = [seg.select(F.floor(F.col("s") / fan**i).alias("s"), F.floor(F.col("s") / fan ** (i + 1)).alias("b")).distinct().groupBy("b").count().agg(F.max("count")).first()[0] for i in (0, 1)]
    top = seg.select(F.floor(F.col("s") / fan**2).alias("s")).distinct().count()
    assert max(*sizes, top) <= max(fan, 20_000 * 100_003 // 4096 // fan**2 + 1) < 200
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_seg_up") > 2 and plan.count("_seg_up_up") > 2
