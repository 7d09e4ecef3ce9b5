"""Components against a plain search; clashing names."""

import random

from pyspark.sql import functions as F

from loomstone.llm.common import components, packed, unpacked


def plain(edges):
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out: dict = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                node = todo.pop()
                if node not in out:
                    out[node] = start
                    todo += near[node]
    return out


def test_components(spark):
    rng = random.Random(1)
    names = list(range(-50, 450))
    rng.shuffle(names)
    chain = [(names[i], names[i + 1]) for i in range(120)]
    ordered = [(1000 + i, 1001 + i) for i in range(150)]
    star = [(names[200], n) for n in names[201:280]]
    ring = [(names[300 + i], names[300 + (i + 1) % 40]) for i in range(40)]
    loose = [(names[400], names[400]), (names[401], names[402]), (names[402], names[401])]
    edges = chain + ordered + star + ring + loose
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == plain(edges)
    keyed = spark.createDataFrame([(bytes([a % 256]), bytes([b % 256])) for a, b in star], "a binary, b binary")
    assert len({bytes(r["component"]) for r in components(keyed).collect()}) == 1


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_packed_rows_come_back(spark):
    df = spark.createDataFrame([(1, "x", 2)], "doc_id long, `we.ird` string, _row int")
    back = packed(df).select(*unpacked(df.columns, doc_id=F.lit(9)))
    assert back.columns == df.columns and tuple(back.first()) == (9, "x", 2)
