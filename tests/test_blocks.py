"""Block scoring gives the same as brute force, in one block or many."""

import os

import numpy as np
from pyspark.sql import functions as F

from loomstone.operators import lexical as lx
from loomstone.plans import blocks
from loomstone.plans.blocks import best_per_class, nearest, per_block, query_blocks
from loomstone.plans.filtered import filtered_search


def vectors(n, d=5, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[1] = v[0]  # equal vectors: ties go to the smaller id
    return v


def frames(spark, v):
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(len(v))]
    q = spark.createDataFrame(rows, "query_id long, vector array<double>, group long")
    c = spark.createDataFrame(rows, "item_id long, vector array<double>, group long")
    return q.unionByName(spark.createDataFrame([(999, None, 0)], q.schema)), c


def brute(v, k, metric="l2sq", group=False):
    out = {}
    for i in range(len(v)):
        d = ((v - v[i]) ** 2).sum(1) if metric == "l2sq" else -(v @ v[i]) / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[i]))
        ids = [j for j in range(len(v)) if j != i and (not group or j % 3 == i % 3)]
        out[i] = sorted(ids, key=lambda j: (round(d[j], 9), j))[:k]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["item_id"])
    return out


def test_nearest_in_one_block_and_many(spark):
    v = vectors(60)
    q, c = frames(spark, v)
    for metric in ("l2sq", "cosine"):
        for group in (False, True):
            want = brute(v, 6, metric, group)
            assert collected(nearest(q, c, 6, metric, True, group)) == want
            assert collected(nearest(q, c, 6, metric, True, group, query_block=9)) == want


def test_best_per_class_in_one_block_and_many(spark):
    v = vectors(40)
    q, c = frames(spark, v)
    refs = c.withColumnRenamed("group", "class")
    n = v / np.linalg.norm(v, axis=1)[:, None]
    sim = n @ n.T
    want = {(i, k): max(sim[i, j] for j in range(40) if j % 3 == k and j != i) for i in range(40) for k in range(3)}
    for limits in ({}, {"query_block": 7}):
        got = {(r["query_id"], r["class"]): r["score"] for r in best_per_class(q, refs, True, **limits).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_filtered_search_falls_back(spark):
    v = vectors(30)
    q, c = frames(spark, v)
    q = q.withColumn("group", F.when(F.col("query_id") < 10, F.lit(77)).otherwise(F.col("group")).cast("long"))
    got = collected(filtered_search(q.filter("vector is not null"), c, 4, skip_same=True))
    whole, own = brute(v, 4), brute(v, 4, group=True)
    assert got == {i: (whole[i] if i < 10 else own[i]) for i in range(30)}


def test_many_queries_in_blocks(spark):
    """10,000 queries are at least five blocks: every one finds what a plain search finds, and what is left is a read of stored hits."""
    rng = np.random.default_rng(8)
    asked, items = rng.integers(-9, 10, (10_000, 4)).astype(float), rng.integers(-9, 10, (300, 4)).astype(float)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "item_id long, vector array<double>")
    found = nearest(q, c, 3, query_block=2048)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan and "MapInArrow" not in plan and "Exchange" not in plan
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) >= 5
    got = collected(found)
    dist = ((asked[:, None] - items[None]) ** 2).sum(2)
    want = np.lexsort((np.broadcast_to(np.arange(300), dist.shape), dist), axis=1)[:, :3]
    assert len(got) == 10_000 and all(got[i] == want[i].tolist() for i in range(10_000))


def test_blocks_hold_their_bounds(spark):
    """Texts of very unequal size: no block passes its keys or bytes but for a key that does so alone, and every key lies in one block."""
    rows = [(i, "x" * (20_000 if i == 7 else 400 if i % 3 else 3)) for i in range(60)] + [(5, "again"), (6, None)]
    queries = spark.createDataFrame(rows, "query_id long, text string")
    for keys, most in ((9, 1 << 30), (1000, 12_000), (1000, 1 << 30)):
        blocks = [[tuple(r) for r in b.collect()] for b in query_blocks(queries, "query_id", keys, most)]
        assert sorted(map(str, (r for b in blocks for r in b))) == sorted(map(str, rows))
        assert sum(len({q for q, _ in b}) for b in blocks) == 60
        for b in blocks:
            held = {q for q, _ in b}
            size = sum(24 + 4 * len(t or "") for _, t in b)
            assert len(held) <= keys and (size <= most or 7 in held)
    assert len(query_blocks(queries, "query_id", 1000, 12_000)) > 4


def test_blocks_run_in_turn(spark):
    """One broadcast lives at a time, and results stay readable after all are gone."""
    queries = spark.createDataFrame([(i,) for i in range(50)], "query_id long")
    alive, seen = [], []

    def search(sent):
        assert all(b._path is None or not os.path.exists(b._path) for b in alive)
        alive.append(sent)
        seen.append(len(sent.value))
        return spark.createDataFrame([(q,) for q in sent.value], "query_id long")

    out = per_block(queries, "query_id", 10, lambda rows: rows.column("query_id").to_pylist(), search)
    assert len(seen) >= 5 and max(seen) <= 10
    assert sorted(r[0] for r in out.collect()) == list(range(50))
    assert per_block(queries.limit(0), "query_id", 10, lambda rows: rows.column("query_id").to_pylist(), search).count() == 0


def test_vectors_of_unequal_length_never_meet(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [9.0] * 4)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(10, [1.0, 2.0, 3.0], 0), (11, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (12, [4.0, 5.0], 1)], "item_id long, vector array<double>, class long")
    assert collected(nearest(q, c, 5)) == {1: [10], 2: [11]}
    got = {(r["query_id"], r["class"]): round(r["score"], 9) for r in best_per_class(q, c).collect()}
    assert got == {(1, 0): 1.0, (1, 1): -1.0, (2, 0): -1.0, (2, 1): 1.0, (3, 0): -1.0, (3, 1): -1.0}


TEXTS = ["the red fox", "the the dog dog dog", "", "a red red dog", "nothing here the", "fox fox the red", "... !!!"]


def okapi(texts, query, k1=1.5, b=0.75, eps=0.25):
    """Straight from the published formula."""
    docs = {i: t.split() if "!" not in t else [] for i, t in enumerate(texts) if t}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    vocab = {w for d in docs.values() for w in d}
    idf = {w: np.log(n - sum(w in d for d in docs.values()) + 0.5) - np.log(sum(w in d for d in docs.values()) + 0.5) for w in vocab}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (x if x >= 0 else eps * mean) for w, x in idf.items()}
    return {
        i: sum(idf.get(w, 0) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avgdl)) for w in query.split())
        for i, d in docs.items()
    }


def test_bm25_in_one_block_and_many(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "chunk_id long, content string")
    asked = {1: "red fox fox", 2: "the dog", 3: "unknown words"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    index = lx.forward_index(chunks).cache()
    terms, n, avgdl = lx.bm25_index(index)
    assert n == 6
    for limits in ({}, {"query_block": 1}):
        got = lx.bm25_search(queries, index, terms, avgdl, 10, **limits).collect()
        for q, text in asked.items():
            want = {i: s for i, s in okapi(TEXTS, text).items() if s > 0}
            mine = {r["item_id"]: r["raw_score"] for r in got if r["query_id"] == q}
            assert mine.keys() == want.keys()
            assert all(abs(mine[i] - want[i]) < 1e-9 for i in want)
            if want:
                assert max(r["score"] for r in got if r["query_id"] == q) == 1.0


def test_scoring_holds_little_whatever_the_batch(spark):
    """A batch of 20,000 chunks against 400 queries: what a task holds at once is bounded by tiles, not by the batch."""
    import tracemalloc

    import pyarrow as pa

    n, n_q, words = 20_000, 400, [f"w{i}" for i in range(50)]
    rng = np.random.default_rng(5)
    counts = [[{"term": words[t], "tf": 1 + int(t) % 3} for t in sorted(rng.choice(50, 3, replace=False))] for _ in range(n)]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([6] * n, pa.int32()), pa.array(counts, kind)], ["item_id", "dl", "counts"])
    asked = [(q, words[t], 1.0 + t / 7) for q in range(n_q) for t in (q % 50, (q * 7 + 1) % 50)]
    weights = pa.table({"query_id": pa.array([a[0] for a in asked], pa.int64()), "term": [a[1] for a in asked], "weight": [a[2] for a in asked]})

    class Table:
        def mapInArrow(self, scan, schema):
            return scan

    class Sent:
        value = lx._by_term(weights)

    scan = lx._scored(Table(), Sent, 6.0, 5)
    tracemalloc.start()
    found = pa.Table.from_batches(list(scan(iter([batch])))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    score = np.zeros((n_q, n))
    weight = {(q, t): sum(w for a, b, w in asked if (a, b) == (q, t)) for q, t, _ in asked}
    holders = {t: [(i, c["tf"]) for i, row in enumerate(counts) for c in row if c["term"] == t] for t in words}
    for (q, t), w in weight.items():
        for i, tf in holders[t]:
            score[q, i] += w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 6 / 6.0))
    for q in (0, 1, 7, 399):
        want = sorted(range(n), key=lambda i: (-round(score[q, i], 9), i))[:5]
        assert [r["item_id"] for r in found if r["query_id"] == q] == want


def test_equal_distances_go_to_the_smaller_id_in_any_order():
    """Items that arrive by falling id, most of them at equal distances, a query's own item left out."""
    from loomstone.plans.blocks import Nearest

    rng = np.random.default_rng(6)
    dist = rng.integers(0, 4, (7, 900)).astype(float)
    dist[:, ::11], dist[3, :] = np.inf, np.nan
    ids, own = np.arange(900)[::-1].copy(), np.array([899, 5, 898, 1, 2, 3, 4])
    best = Nearest(7, 6)
    for at in range(0, 900, 50):
        best.add(np.arange(7), ids[at : at + 50], dist[:, at : at + 50], own)
    got = best.batch(np.arange(7)).to_pylist()
    for q in range(7):
        order = sorted((d, i) for d, i in zip(dist[q], ids) if np.isfinite(d) and i != own[q])[:6]
        assert [(r["distance"], r["item_id"]) for r in got if r["query_id"] == q] == order


def test_products_in_32_bits_only_rule_out(monkeypatch):
    """Squared distances are those of 64 bits, also between numbers that 32 bits cannot tell apart or hold, and few pairs are measured."""
    rng = np.random.default_rng(5)
    measured = []
    pairs = blocks.near_pairs
    monkeypatch.setattr(blocks, "near_pairs", lambda *a: (lambda out: measured.append(len(out[0])) or out)(pairs(*a)))
    near = rng.normal(size=(3000, 8)) * 1e-6 + 1000.0  # about 3e-7 apart, each of a square near 1e7
    for v, few in ((rng.normal(size=(3000, 8)), True), (near, False), (rng.normal(size=(300, 8)) * 1e25, False), (np.r_[rng.normal(size=(300, 8)), [[np.nan] * 8, [np.inf] * 8]], False)):
        measured.clear()
        ids, own = np.arange(len(v)), np.arange(len(v))
        best = blocks.Nearest(len(v), 5)
        for low in range(0, len(v), 1000):
            blocks._meet_l2sq(best, ids, v, ids[low : low + 1000], v[low : low + 1000], own, low)
        best.settle()
        for i in rng.integers(0, 300, 20):
            d = ((v[i] - v) ** 2).sum(1)
            d[i] = np.inf
            order = np.lexsort((ids, np.round(d, 9)))[:5]
            assert best.ids[i].tolist() == order.tolist()
            assert np.allclose(best.dist[i], d[order], rtol=1e-12)
        if few:
            assert sum(measured) < 30 * len(v)
