"""Ranked lexical search by bag deduplication: documents alike in the items' terms and in length class are scored once, then expanded."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import small_batches, stored

VOCABULARY = 200_000  # terms of a block of items
POSTINGS = 2_000_000  # (term, item) pairs of a block
PIECE = 1 << 22  # bytes of a text taken apart at once
CELLS = 2_000_000  # class x item scores, and class x term x item additions, held at once
LAST = (1 << 63) - 1  # where documents without an id come in order

# Fixed values of the term rule: 0-9, a-z and every byte from 0x80 on belong to a term, A-Z as a-z, nothing else.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a list for every few megabytes, cut between terms."""
    raw = (text or "").encode("utf-8", "replace").translate(TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def weight(documents: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2df + 1))), in doubles."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """Items that are searched together: their distinct terms, numbered, and for each term the items that hold it."""

    def __init__(self):
        self.keys: list = []  # item ids, by item number
        self.number: dict[bytes, int] = {}
        self.holders: list[list[int]] = []
        self.postings = 0

    def add(self, key, own: set[bytes]) -> None:
        for term in sorted(own):
            at = self.number.setdefault(term, len(self.holders))
            if at == len(self.holders):
                self.holders.append([])
            self.holders[at].append(len(self.keys))
        self.postings += len(own)
        self.keys.append(key)

    def fits(self, own: set[bytes], vocabulary: int) -> bool:
        return len(self.number) + len(own) <= vocabulary and self.postings + len(own) <= POSTINGS


def blocks(items: DataFrame, vocabulary: int) -> Iterator[Block]:
    """Distinct items (item_id, text) in bounded blocks, one at a time; an item with more terms than a block may have is one alone."""
    block = Block()
    for row in items.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        own = {t for piece in terms(row["text"]) for t in piece}
        if own:
            if block.keys and not block.fits(own, vocabulary):
                yield block
                block = Block()
            block.add(row["item_id"], own)
    if block.keys:
        yield block


def _bags(number):
    """Texts -> (doc_id, n, bag): all terms counted, and of the block's the numbers, ascending, then how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        for batch in batches:
            ns, bags = [], []
            for text in batch.column("text"):
                n, held = 0, Counter()
                for piece in terms(text.as_py()):
                    n += len(piece)
                    held.update(map(get, piece))
                held.pop(None, None)
                ns.append(n)
                own = np.array(sorted(held.items()), np.int32).reshape(-1, 2)
                bags.append(np.ascontiguousarray(own.T, "<i4").tobytes())
            keep = pa.array([n > 0 for n in ns])
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])
            yield rows.filter(keep)

    return run


def unbagged(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of every entry."""
    sizes = np.array([len(b) // 8 for b in bags], np.int64)
    flat = np.frombuffer(b"".join(bags), "<i4")
    row = np.repeat(np.arange(len(bags)), sizes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(2 * (np.cumsum(sizes) - sizes), sizes) + inside
    return row, flat[at], flat[at + np.repeat(sizes, sizes)].astype(np.int64)


def _frequencies(count: int):
    """Classes -> (term, df): how many documents of a task's classes hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(count, np.int64)
        for batch in batches:
            row, term, _ = unbagged(batch.column("bag").to_pylist())
            np.add.at(df, term, batch.column("members").to_numpy()[row])
        held = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], ["term", "df"])

    return run


class Best:
    """Of every item the k classes of a task that come first by (score falling, first document), and the score that one must reach."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = tuple(np.empty(0, np.int64) for _ in range(4))  # item, class, score, first document

    def add(self, scores: np.ndarray, classes: np.ndarray, first: np.ndarray) -> None:
        """scores: classes x items."""
        c, i = np.nonzero(scores >= self.floor[None])
        if not len(c):
            return
        item, cls, score, doc = (np.concatenate(x) for x in zip(self.rows, (i, classes[c], scores[c, i], first[c])))
        order = np.lexsort((doc, -score, item))
        item, cls, score, doc = item[order], cls[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = rank == self.k - 1
        self.floor[item[full]] = np.maximum(self.floor[item[full]], score[full])
        keep = rank < self.k
        self.rows = (item[keep], cls[keep], score[keep], doc[keep])


def _scored(model, k: int):
    """Classes -> for every item the k best of the task's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, holders, items = model.value
        lengths = np.diff(starts)
        best = Best(items, k)
        for batch in batches:
            row, term, tf = unbagged(batch.column("bag").to_pylist())
            m, cls, first = (batch.column(c).to_numpy() for c in ("m", "cls", "first"))
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            work = np.cumsum(np.bincount(row, lengths[term], batch.num_rows) + items) // CELLS  # classes are taken together as far as their work allows
            ends = [0, *(np.nonzero(np.diff(work))[0] + 1).tolist(), batch.num_rows]
            entry = np.searchsorted(row, ends)
            for lo, hi, a, b in zip(ends, ends[1:], entry, entry[1:]):
                if a < b:
                    times = lengths[term[a:b]]
                    inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    cell = np.repeat((row[a:b] - lo) * items, times) + holders[np.repeat(starts[term[a:b]], times) + inside]
                    scores = np.zeros((hi - lo) * items, np.int64)
                    np.add.at(scores, cell, np.repeat(value[a:b], times))
                    best.add(scores.reshape(-1, items), cls[lo:hi], first[lo:hi])
        yield pa.RecordBatch.from_arrays([pa.array(best.rows[0].astype(np.int32)), *map(pa.array, best.rows[1:])], ["item", "cls", "score", "first"])

    return run


def length_class(documents: int, total: int) -> Column:
    """m = 10 + (90 n N) div L of column n, the product in decimals so that it cannot overflow."""
    return F.expr(f"CAST(10 + (CAST(n AS DECIMAL(13,0)) * CAST({90 * documents} AS DECIMAL(25,0))) DIV CAST({max(1, total)} AS DECIMAL(20,0)) AS BIGINT)")


def _search(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    number = spark.sparkContext.broadcast(block.number)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = stored(docs.mapInArrow(_bags(number), f"doc_id {kind}, n long, bag binary"), "bags")
    sums = bags.agg(F.count("*").alias("documents"), F.sum("n").alias("total")).collect()[0]
    documents, total = sums["documents"], sums["total"] or 0
    known = bags.where("length(bag) > 0").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "doc_id", length_class(documents, total).alias("m"), "bag")
    known = known.withColumn("digest", F.xxhash64("m", "bag"))

    # Equal digests bring rows together, equal bags and m make them one class: the aggregate compares all three.
    classes = known.groupBy("digest", "m", "bag").agg(F.count("*").alias("members"), F.min("doc").alias("first"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    df = classes.select("bag", "members").mapInArrow(_frequencies(len(block.holders)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.zeros(len(block.holders), np.int64)
    for r in df:
        weights[r["term"]] = weight(documents, r["df"])
    starts = np.cumsum([0, *map(len, block.holders)])
    model = spark.sparkContext.broadcast((weights, starts, np.concatenate([np.array(h, np.int64) for h in block.holders]), len(block.keys)))

    scored = classes.select("cls", "m", "bag", "first").mapInArrow(_scored(model, k), "item int, cls long, score long, first long")
    top = Window.partitionBy("item").orderBy(F.desc("score"), "first")
    chosen = stored(scored.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("item", "cls", "score"), "chosen")

    # Of the first k classes of an item only the first k members can be among its first k documents.
    wanted = stored(classes.join(chosen.select("cls").distinct(), "cls").select("cls", "digest", "m", "bag"), "wanted")
    own = Window.partitionBy("cls").orderBy("doc")
    members = known.join(wanted, ["digest", "m", "bag"]).withColumn("at", F.row_number().over(own)).where(F.col("at") <= k).select("cls", "doc", "doc_id")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    found = chosen.join(members, "cls").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    keys = spark.createDataFrame([(i, key) for i, key in enumerate(block.keys)], "item int, item_id long")
    return stored(found.join(keys, "item").select("item_id", "rank", "doc_id", "score"), "found")


def search(docs: DataFrame, items: DataFrame, k: int = 10, vocabulary: int = VOCABULARY) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` (doc_id, text) for every item of ``items`` (item_id, text): item_id, rank, doc_id, score.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))); a document scores
    for each of the item's terms weight * (10^9 tf div (1000 tf + 8 m)), with
    m = 10 + 90 n N div L. Only scores above 0 count, equal ones go by ascending
    doc_id, null last.

    Items are taken in blocks of at most ``vocabulary`` terms, so what is sent
    to the tasks has a bound. One pass over the texts leaves of each document
    its length and its bag: how often it has each of the block's terms. Equal
    bags of equal m are one class, which is scored once and has its documents
    counted for df. A task keeps the k best classes of an item, by score and
    smallest member; only the members of these are looked up, k of each.

    Every row of ``docs`` is a document, repeated rows too. Null and empty texts
    have no term and count nowhere. An item is a distinct (item_id, text); one
    without terms has no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs, found = docs.select("doc_id", "text"), None
    for block in blocks(items, vocabulary):
        part = _search(docs, block, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"item_id long, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    return found
