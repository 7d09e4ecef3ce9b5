"""An index after several ingests equals one built anew; versions commit by their manifest."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators import lexical as lx
from loomstone.operators import lexical_store as ls

CHUNK = "path string, chunk_id long, content string"


def frames(spark, texts):
    rows = [(p, i, t) for p, parts in texts.items() for i, t in parts]
    return spark.createDataFrame(rows, CHUNK)


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def numbers(terms):
    return {r["term"]: (r["df"], r["cf"], round(r["weight_idf"], 9)) for r in terms.collect()}


def rebuilt(spark, texts):
    index = lx.forward_index(frames(spark, texts))
    terms, n, avgdl = lx.bm25_index(index)
    return {r["item_id"]: (r["dl"], sorted(map(tuple, r["counts"]))) for r in index.collect()}, numbers(terms), n, round(avgdl, 9)


def opened(spark, store, version=None):
    index, terms, n, avgdl = ls.open_index(spark, store, version)
    return {r["item_id"]: (r["dl"], sorted(map(tuple, r["counts"]))) for r in index.collect()}, numbers(terms), n, round(avgdl, 9)


def test_three_ingests_equal_a_rebuild(spark, tmp_path):
    store = str(tmp_path / "store")
    now = {"a": [(1, "red fox red"), (2, "dog")], "b": [(3, "the dog runs")], "c": [(4, "only here"), (5, "")], "d": [(6, None)]}
    ls.ingest(spark, store, paths(spark, [*now, "a"]), frames(spark, now))
    assert opened(spark, store) == rebuilt(spark, now)

    # b changes, c goes, e comes; a chunk of a path that is not touched is left out
    now = {"a": now["a"], "b": [(3, "the cat")], "d": now["d"], "e": [(7, "fox fox")]}
    second = ls.ingest(spark, store, paths(spark, ["b", "c", "e", "never"]), frames(spark, {"b": now["b"], "e": now["e"], "a": [(99, "stray")]}))
    assert opened(spark, store) == rebuilt(spark, now)
    before = opened(spark, store)

    # c comes back, a loses a chunk
    now = {**now, "a": [(1, "red")], "c": [(4, "here again")]}
    ls.ingest(spark, store, paths(spark, ["a", "c"]), frames(spark, {"a": now["a"], "c": now["c"]}))
    assert opened(spark, store) == rebuilt(spark, now)
    assert opened(spark, store, second) == before

    folded = ls.compact(spark, store)
    assert len(folded.generations) == 1 and opened(spark, store) == rebuilt(spark, now)
    assert ls.compact(spark, store) == folded

    index, terms, _, avgdl = ls.open_index(spark, store)
    asked = spark.createDataFrame([(1, "again red")], "query_id long, text string")
    assert {r["item_id"] for r in lx.bm25_search(asked, index, terms, avgdl, 5).collect()} == {1, 4}

    # every path goes, and the store goes on
    ls.ingest(spark, store, paths(spark, list(now)), frames(spark, now).limit(0))
    index, terms, n, avgdl = ls.open_index(spark, store)
    assert (index.count(), terms.count(), n, avgdl) == (0, 0, 0, 0.0)


def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    assert ls.current(spark, store) == ls.Version(0, ())
    assert opened(spark, store) == ({}, {}, 0, 0.0)
    now = {"a": [(1, "red fox")]}
    ls.ingest(spark, store, paths(spark, now), frames(spark, now))
    good = ls.current(spark, store)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ls, "commit", dies)
        with pytest.raises(OSError):
            ls.ingest(spark, store, paths(spark, ["a"]), frames(spark, {"a": [(1, "blue")]}))
    assert ls.current(spark, store) == good and opened(spark, store) == rebuilt(spark, now)
    # a manifest begun and not finished is none either
    spark.range(1).select(F.lit(0).alias("place"), F.lit("x").alias("generation")).write.json(f"{store}/manifests/v{2:012d}")
    (tmp_path / "store" / "manifests" / f"v{2:012d}" / "_SUCCESS").unlink()
    assert ls.current(spark, store) == good
