"""Mixing: targets against a plain reshare loop, copies against the rates."""

import math

import pytest

from loomstone.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if total and left * weight[s] / total > cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = float(cap * sizes[s])
        left = share * sum(sizes.values()) - sum(full.values())


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10, "d": 0}, {"a": 100, None: 50, "é": 7, "z": 7}, {"a": 5}, {"b": 1, "a": 1_000_000, "c": 2}, {f"s{i}": i * i for i in range(40)}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want)
    for s in want:
        assert math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9)


def rows():
    out = [(i, f"s{i % 3}" if i % 7 else None, " ".join(["w"] * (i % 50))) for i in range(3000)]
    return out + [(None, "s1", None), (None, "s1", "two words"), (5000, "s2", ""), (5000, "s2", ""), (5001, "s0", "long " * 100_000)]


def test_copies_follow_rates_and_reruns_agree(spark):
    docs = spark.createDataFrame([(d, s, t, 9) for d, s, t in rows()], "doc_id long, source string, text string, SIZE int")
    first = sorted(map(str, mixing.mixture(docs).collect()))
    assert first == sorted(map(str, mixing.mixture(docs.repartition(11)).collect()))
    sums: dict = {}
    for r in mixing.mixture(docs).collect():
        assert r["taken"] <= 2 * r["size"]
        own = sums.setdefault(r["target"], [0, 0])
        own[0] += r["taken"]
        own[1] = r["target"]
    assert len(first) == len(rows())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = sum(mixing.mixture(docs).select("taken").toPandas()["taken"])
    assert sum(len((r["text"] or "").split()) for r in mixed.select("text").collect()) == taken


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixture(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", " \n"), (2, None, None)], "doc_id long, source string, text string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mixture(blank).collect()] == [(0, 0.0, 0)] * 2
