"""Exact scoring of a query table against a corpus table, block by block.

The corpus is never joined row by row with the queries, never copied and never
shuffled. The queries are cut into blocks of a bounded number of keys and bytes.
Blocks run in turn: a block is collected, broadcast, met with one scan of the
corpus in which every task passes on only the best ``k`` rows per query, its
result is written to the shared folder, and its broadcast is destroyed before
the next block is read. The driver and every executor thus hold one block,
however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions.vectors import block_distance, kth_bound, lifted, near_pairs
from loomstone.session import fresh_path, written

QUERY_BLOCK = 16384  # queries of a block
BLOCK_BYTES = 64 << 20  # bytes of a block
TILE = 1024  # queries of a block whose scores are held at once
CELLS = 250_000  # numbers of a score matrix held at once
BATCH_ROWS = 2000  # corpus rows that reach a task together
_SLICES = 16  # slices of keys for each block, of which blocks are put together


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes: characters of texts at four, elements of arrays at eight, eight for all else."""
    size = F.lit(0).cast("long")
    for field in df.schema:
        kind = field.dataType.typeName()
        held = F.length(field.name) * 4 if kind == "string" else F.size(field.name) * 8 if kind == "array" else F.lit(8)
        size = size + F.greatest(F.coalesce(held.cast("long"), F.lit(0)), F.lit(0)) + 8
    return size


def query_blocks(held: DataFrame, key: str, block: int, most_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Blocks of a stored query table of at most ``block`` keys and ``most_bytes`` bytes each.

    Keys are dealt by hash to slices much smaller than a block, and neighbouring
    slices are put together as long as both bounds hold. Only a slice that
    passes a bound by itself, such as one key with more than ``most_bytes``,
    makes a block beyond it. Rows of a key stay together.
    """
    sized = held.groupBy(key).agg(F.sum(row_bytes(held)).alias("bytes"))
    total = sized.agg(F.count("*").alias("keys"), F.sum("bytes").alias("bytes")).first()
    blocks = max(1, -(-total["keys"] // block), -(-(total["bytes"] or 0) // most_bytes))
    if blocks == 1:
        return [held]
    slices = blocks * min(_SLICES, block)
    at = F.pmod(F.xxhash64(key), F.lit(slices))
    loads = sized.groupBy(at.alias("slice")).agg(F.count("*").alias("keys"), F.sum("bytes").alias("bytes")).collect()
    ends, keys, used = [], 0, 0
    for row in sorted(loads, key=lambda r: r["slice"]):
        if keys and (keys + row["keys"] > block or used + row["bytes"] > most_bytes):
            ends.append(row["slice"])
            keys, used = 0, 0
        keys, used = keys + row["keys"], used + row["bytes"]
    return [held.where((at >= low) & (at < high)) for low, high in zip([0, *ends], [*ends, slices])]


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Tasks get at most ``rows`` rows at once, so that what a task holds does not grow with its share of the corpus."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def per_block(
    queries: DataFrame,
    key: str,
    block: int,
    pack: Callable[[pa.Table], object],
    search: Callable[[Broadcast], DataFrame],
    most_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All blocks' results, read from the shared folder.

    ``pack`` makes of a block's rows what is broadcast; ``search`` gives the
    finished rows of that block. A key lies in one block, so ranks within a
    block are final.
    """
    spark = queries.sparkSession
    held = written(queries, "queries")
    path, schema, parts = fresh_path(spark, "found"), None, []
    for n, rows in enumerate(query_blocks(held, key, block, most_bytes)):
        sent = spark.sparkContext.broadcast(pack(rows.toArrow().combine_chunks()))
        found = search(sent)
        schema = found.schema
        parts.append(f"{path}/block={n}")
        with small_batches(spark):
            found.write.mode("overwrite").parquet(parts[-1])
        sent.destroy()
    return spark.read.schema(schema).parquet(*parts)


def best_rows(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query with their ``rank``."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)


def _within(distance: np.ndarray) -> np.ndarray:
    """A little more, as what rounds to the same may have the smaller id."""
    return distance + 2e-9 + 1e-12 * np.abs(distance)


class Nearest:
    """The ``k`` nearest items so far of every query of a block, by distance rounded to nine digits and then by id.

    Only distances that the k-th one held lets in are taken up. They wait until
    they are as many as the places, and are then put in order with those held.
    Infinite distances and those that are no number take no part.
    """

    def __init__(self, n: int, k: int):
        self.ids, self.dist, self.k = np.zeros((n, k), np.int64), np.full((n, k), np.inf), k
        self.most = np.full(n, np.finfo(np.float64).max)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.seen = 0

    def step(self, items: int, most: int, seen: int | None = None) -> int:
        """Items to score next, ``most`` at most: few at first, when any distance is taken up, then as many as were seen."""
        return max(1, min(items, most, max(self.k, self.seen if seen is None else seen)))

    def add(self, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, own: np.ndarray | None = None) -> None:
        """dist: these queries x these items. ``own`` has the id of every query of the block, whose own item is passed over."""
        at = np.flatnonzero(dist <= self.most[rows][:, None])
        row, col = np.divmod(at, len(ids))
        self.take(rows[row], ids[col], dist[row, col], own)

    def take(self, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, own: np.ndarray | None = None) -> None:
        """Pairs of a query and an item whose distance the k-th one held lets in."""
        found = rows, ids, dist
        if own is not None:
            other = own[rows] != ids
            found = tuple(x[other] for x in found)
        self.waiting.append(found)
        if sum(len(x[0]) for x in self.waiting) > self.ids.size:
            self.settle()

    def expect(self, rows: np.ndarray, bound: np.ndarray) -> None:
        """The k-th distances of these queries do not pass ``bound``, so what lies beyond it need not be taken up."""
        self.most[rows] = np.minimum(self.most[rows], _within(bound))

    def settle(self) -> None:
        held = np.isfinite(self.dist)
        self.waiting.append((np.nonzero(held)[0], self.ids[held], self.dist[held]))
        row, ids, dist = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = []
        key = np.round(dist, 9)
        order = np.argsort(key)
        order = order[np.argsort(row[order].astype(np.min_scalar_type(len(self.ids))), kind="stable")]
        tied = (np.diff(key[order]) == 0) & (np.diff(row[order]) == 0)
        if tied.any():  # only then do ids decide
            order = np.lexsort((ids, key, row))
        row = row[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(starts, np.diff(starts, append=len(row)))
        first = place < self.k
        row, place, order = row[first], place[first], order[first]
        self.dist[:] = np.inf
        self.ids[row, place], self.dist[row, place] = ids[order], dist[order]
        last = self.dist[:, -1]
        full = np.isfinite(last)
        self.most[full] = np.minimum(self.most[full], _within(last[full]))

    def batch(self, query_ids: np.ndarray, score: str = "distance", sign: float = 1.0) -> pa.RecordBatch:
        self.settle()
        keep = np.isfinite(self.dist)
        columns = [np.broadcast_to(query_ids[:, None], keep.shape)[keep], self.ids[keep], sign * self.dist[keep]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "item_id", score])


_HIT = "query_id long, item_id long, distance double"


def _by_length(ids: np.ndarray, vectors: pa.Array, groups: np.ndarray | None) -> Iterator[tuple]:
    """(row numbers, ids, matrix, groups) for every vector length that occurs."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.nonzero(lengths == n)[0]
        matrix = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        yield at, ids[at], matrix, None if groups is None else groups[at]


def _column(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def _unpacked(table: pa.Table, group: bool) -> dict:
    """A block of queries by vector length."""
    ids = _column(table, "query_id")
    vectors = table.column("vector").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
    by_length = {m.shape[1]: (at, m, g) for at, _, m, g in _by_length(ids, vectors, _column(table, "group") if group else None)}
    return {"ids": ids, "by_length": by_length}


def _vectors(df: DataFrame, id_col: str, *more: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col("vector").cast("array<double>").alias("vector"), *[F.col(m).cast("long").alias(m) for m in more])
    return rows.filter(F.size("vector") > 0)


def _meet(best: Nearest, rows: np.ndarray, wanted: np.ndarray, ids: np.ndarray, matrix: np.ndarray, own: np.ndarray | None, seen: int, metric: str) -> None:
    """Every query row with every item row, tile by tile; ``seen`` items met these queries before."""
    at = 0
    while at < len(ids):
        step = best.step(len(ids) - at, CELLS // min(TILE, len(rows)), seen + at)
        for low in range(0, len(rows), TILE):
            tile = slice(low, low + TILE)
            best.add(rows[tile], ids[at : at + step], block_distance(wanted[tile], matrix[at : at + step], metric), own)
        at += step


def _meet_l2sq(best: Nearest, rows: np.ndarray, wanted: np.ndarray, ids: np.ndarray, matrix: np.ndarray, own: np.ndarray | None, seen: int) -> None:
    """The same for squared distances, most of which a product in 32 bits settles.

    Where more items come than were seen, the k-th distance among them bounds what is taken up.
    """
    fine = np.isfinite(np.einsum("ij,ij->i", matrix, matrix))  # all else is at no finite distance
    if not fine.all():
        ids, matrix = ids[fine], matrix[fine]
    given = lifted(matrix, False)
    if seen < len(ids) and best.k <= len(ids):
        few = max(1, 2 * CELLS // len(ids))
        for low in range(0, len(rows), few):
            tile = slice(low, low + few)
            passed = None if own is None else own[rows[tile]][:, None] == ids
            best.expect(rows[tile], kth_bound(lifted(wanted[tile], True), given, best.k, passed))
    for low in range(0, len(rows), TILE):
        tile = slice(low, low + TILE)
        asked = lifted(wanted[tile], True)
        step = max(1, 2 * CELLS // len(asked))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            row, col, dist = near_pairs(wanted[tile], matrix[part], asked, given[part], best.most[rows[tile]])
            best.take(rows[tile][row], ids[part][col], dist, own)


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = "l2sq",
    skip_same: bool = False,
    group: bool = False,
    query_block: int = QUERY_BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact ``k`` nearest corpus rows per query: (query_id, item_id, distance, rank).

    ``queries`` is (query_id, vector[, group]) and ``corpus`` (item_id,
    vector[, group]); ids and groups are longs. Null vectors take no part, and
    only vectors of one length meet. With ``group`` a query is scored against
    the rows of its own group and no others. Order is by distance rounded to
    nine digits, then by id.
    """
    more = ["group"] if group else []
    items = _vectors(corpus, "item_id", *more)

    def search(sent: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            best, seen = Nearest(len(q["ids"]), k), {}
            meet = _meet_l2sq if metric == "l2sq" else partial(_meet, metric=metric)
            for batch in batches:
                groups = _column(batch, "group") if group else None
                for _, ids, matrix, of in _by_length(_column(batch, "item_id"), batch.column("vector"), groups):
                    if matrix.shape[1] not in q["by_length"]:
                        continue
                    rows, wanted, wanted_of = q["by_length"][matrix.shape[1]]
                    for g in np.intersect1d(wanted_of, of) if group else [None]:
                        asked = np.arange(len(rows)) if g is None else np.nonzero(wanted_of == g)[0]
                        here = slice(None) if g is None else np.nonzero(of == g)[0]
                        own, met = q["ids"] if skip_same else None, (matrix.shape[1], g)
                        meet(best, rows[asked], wanted[asked] if group else wanted, ids[here], matrix[here], own, seen.get(met, 0))
                        seen[met] = seen.get(met, 0) + len(ids[here])
            yield best.batch(q["ids"])

        return best_rows(items.mapInArrow(scan, _HIT), k, F.round("distance", 9), F.col("item_id"))

    asked = _vectors(queries, "query_id", *more)
    return per_block(asked, "query_id", query_block, lambda rows: _unpacked(rows, group), search, block_bytes)


def best_per_class(queries: DataFrame, references: DataFrame, skip_same: bool = False, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Highest cosine of each query to the references of each class: (query_id, class, score).

    ``references`` is (item_id, vector, class) with long classes. Vectors of
    unequal length have cosine -1. Tasks pass on one row per query and class.
    """
    items = _vectors(references, "item_id", "class")

    def search(sent: Broadcast) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = sent.value
            best: dict[int, np.ndarray] = {}
            for batch in batches:
                for _, ids, matrix, of in _by_length(_column(batch, "item_id"), batch.column("vector"), _column(batch, "class")):
                    order = np.argsort(of, kind="stable")
                    ids, matrix, of = ids[order], matrix[order], of[order]
                    own = np.isin(ids, q["ids"]) if skip_same else np.zeros(len(ids), bool)
                    for width, (rows, wanted, _) in q["by_length"].items():
                        step = max(1, CELLS // min(TILE, len(rows)))
                        for at, low in product(range(0, len(ids), step), range(0, len(rows), TILE)):
                            part, tile = slice(at, at + step), slice(low, low + TILE)
                            asked = rows[tile]
                            score = -block_distance(wanted[tile], matrix[part], "cosine") if width == matrix.shape[1] else np.full((len(asked), len(ids[part])), -1.0)
                            mine = np.nonzero(own[part])[0]
                            if len(mine):
                                score[:, mine] = np.where(q["ids"][asked][:, None] == ids[part][mine], -np.inf, score[:, mine])
                            kinds, starts = np.unique(of[part], return_index=True)
                            for c, a, b in zip(kinds, starts, [*starts[1:], score.shape[1]]):
                                high = best.setdefault(c, np.full(len(q["ids"]), -np.inf))
                                high[asked] = np.maximum(high[asked], score[:, a:b].max(1))
            for c, high in best.items():
                keep = np.isfinite(high)
                yield pa.RecordBatch.from_arrays([pa.array(q["ids"][keep]), pa.array(np.full(keep.sum(), c, np.int64)), pa.array(high[keep])], ["query_id", "class", "score"])

        scored = items.mapInArrow(scan, "query_id long, class long, score double")
        return scored.groupBy("query_id", "class").agg(F.max("score").alias("score"))

    return per_block(_vectors(queries, "query_id"), "query_id", query_block, lambda rows: _unpacked(rows, False), search)
