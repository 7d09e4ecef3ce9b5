"""Exact top-k by inner product with a pivot table: bounds from distances to pivots, candidates in bound order, exact stop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import stored

CHUNK = 512  # candidates evaluated between two looks at the bounds
FLOAT_EXACT = float(1 << 53)  # below this every sum of integers is exact in doubles


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as double; null for vectors null or holding null or non-finite parts."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & sound, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


def choose_pivots(rows: list[list[int]], count: int) -> dict[int, np.ndarray]:
    """Farthest-first pivots for every vector length among a bounded sample."""
    by_length: dict[int, list] = {}
    for v in rows:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for n, vs in by_length.items():
        x = np.array(vs, dtype=float).reshape(len(vs), n)
        far, chosen = np.full(len(x), np.inf), [0]
        while len(chosen) < min(count, len(x)):
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        out[n] = x[chosen]
    return out


def distances(x: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, norms[:, None] + (pivots**2).sum(1)[None] - 2 * (x @ pivots.T)))


def _table(pivots: dict[int, np.ndarray]):
    """The pivot table: every vector with its squared norm and its distances to the pivots of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            norms, dists = np.zeros(len(lengths)), [None] * len(lengths)
            for n in np.unique(lengths):  # vectors of one length are one matrix
                at = np.nonzero(lengths == n)[0]
                x = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n).astype(float)
                norms[at] = (x**2).sum(1)
                far = distances(x, norms[at], pivots[n]) if n in pivots else np.zeros((len(at), 0))
                for i, row in zip(at, far):
                    dists[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms), pa.array(dists, pa.list_(pa.float64()))], ["vec_id", "v", "norm", "dists"])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; by doubles where no sum can leave their exact range."""
    most = (np.abs(q).max(initial=0) * 1.0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < FLOAT_EXACT else q @ x.T


class Best:
    """The k best (score, smaller id first) of every query of a wave and the score that a candidate must reach."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.floor, self.k = ids, floor.copy(), k
        self.rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query, candidate, score

    def add(self, at: np.ndarray, candidates: np.ndarray, scores: np.ndarray) -> None:
        """at: which queries; scores: queries x candidates."""
        i, j = np.nonzero((scores >= self.floor[at][:, None]) & (candidates[None] != self.ids[at][:, None]))
        if not len(i):
            return
        q, c, s = (np.concatenate(x) for x in zip(self.rows, (at[i], candidates[j], scores[i, j])))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        starts = np.searchsorted(q, q)
        rank = np.arange(len(q)) - starts
        full = rank == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])
        keep = rank < self.k
        self.rows = (q[keep], c[keep], s[keep])


def _search(wave: dict, k: int):
    """Index rows -> the k best of this task for each query of the wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(wave["ids"], wave["floor"], k)
        for batch in batches:
            lengths = np.asarray(batch.column("v").value_lengths())
            for n in np.unique(lengths):
                at = np.nonzero(wave["lengths"] == n)[0]
                if not len(at):
                    continue
                rows = batch.take(pa.array(np.nonzero(lengths == n)[0]))
                ids = rows.column("vec_id").to_numpy(zero_copy_only=False)
                x = rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), n)
                norms = rows.column("norm").to_numpy(zero_copy_only=False)
                dists = rows.column("dists").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                for lo in range(0, len(at), 1024):
                    _block(best, at[lo : lo + 1024], wave["of"][n], ids, x, norms, dists)
        q, c, s = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(wave["ids"][q]), pa.array(c), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _block(best: Best, at: np.ndarray, queries: dict, ids, x, norms, dists) -> None:
    """One block of queries against one batch of candidates.

    |a - b| >= |d(a,p) - d(b,p)| for every pivot p, and a.b = (|a|^2 + |b|^2 - |a-b|^2) / 2, so the largest such
    difference bounds the product from above. Candidates are evaluated by falling bound; what no query of the
    block can use any more ends the block.
    """
    here = queries["row"][at]
    q, qn, qd = queries["v"][here], queries["norm"][here], queries["dists"][here]
    below = np.zeros((len(at), len(ids)))
    for p in range(dists.shape[1]):
        gap = np.subtract.outer(qd[:, p], dists[:, p])
        np.abs(gap, out=gap)
        np.maximum(below, gap, out=below)
    sums = qn[:, None] + norms[None]
    above = (sums - below**2) / 2 + 1e-6 * (1 + sums)  # the margin covers rounding of the distances
    np.minimum(above, np.sqrt(np.outer(qn, norms)) * (1 + 1e-9) + 1, out=above)
    reach = above.max(0)
    order = np.argsort(-reach)
    for lo in range(0, len(order), CHUNK):
        columns = order[lo : lo + CHUNK]
        floor = best.floor[at]
        live = (above[:, columns] >= floor[:, None]).any(1)
        if reach[columns[0]] < floor.min():
            return
        if live.any():
            best.add(at[live], ids[columns], products(q[live], x[columns]))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, pivots: int = 16, sample: int = 2048, wave: int = 16384) -> DataFrame:
    """The k highest inner products of every query vector: query_id, rank (from 1), vec_id, score.

    ``vectors``: (vec_id, embedding). Queries are the rows that satisfy
    ``is_query``; candidates every row but the query's own; ties go to the
    smaller id. Rows with a null id take no part, nor do vectors that
    ``quantised`` rejects. Every row is a candidate, also of an id that occurs
    again; rows of one id are one query, which gets the highest scores of any of
    them and no row of its own id. Only vectors of one length are compared.

    Pivots come from a sample of at most ``sample`` vectors, which also gives
    every query a first score to beat. The queries are taken in waves of about
    ``wave``; one wave is a bounded broadcast and one scan of the index, and
    only the k best per task and query leave a task. Nothing is approximate:
    the sample steers the order of work, not the result.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))
    v = stored(v.where("vec_id IS NOT NULL AND v IS NOT NULL"), "vectors")
    some = v.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).collect()
    chosen = choose_pivots([r["v"] for r in some], pivots)
    index = stored(v.mapInArrow(_table(chosen), "vec_id long, v array<long>, norm double, dists array<double>"), "pivot_table")
    asked = index.where(is_query)
    waves = max(1, -(-asked.count() // wave))
    found = None
    for w in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).toArrow()
        part = stored(index.mapInArrow(_search(_wave(rows, some, k), k), "query_id long, vec_id long, score long"), "wave")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = part if found is None else found.unionByName(part)
    return found.select("query_id", "rank", "vec_id", "score")


def _wave(rows: pa.Table, some: list, k: int) -> dict:
    """Queries of a wave by vector length, and the k-th best score of each against the sample."""
    rows = rows.combine_chunks()
    ids = rows.column("vec_id").to_numpy()
    vs = rows.column("v").to_pylist()
    lengths = np.array([len(v) for v in vs], dtype=np.int64)
    floor = np.full(len(ids), np.iinfo(np.int64).min)
    of = {}
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        x = np.array([vs[i] for i in at], dtype=np.int64).reshape(len(at), n)
        row = np.zeros(len(ids), np.int64)
        row[at] = np.arange(len(at))
        dists = np.array([rows.column("dists")[int(i)].as_py() for i in at], dtype=float).reshape(len(at), -1)
        of[n] = {"v": x, "norm": rows.column("norm").to_numpy()[at], "dists": dists, "row": row}
        near = [r for r in some if len(r["v"]) == n]
        if len(near) > k:  # one more than k, as the query's own row does not count
            first = Best(ids, floor, k)
            first.add(at, np.array([r["vec_id"] for r in near]), products(x, np.array([r["v"] for r in near], dtype=np.int64).reshape(len(near), n)))
            floor = first.floor
    return {"ids": ids, "lengths": lengths, "floor": floor, "of": of}
