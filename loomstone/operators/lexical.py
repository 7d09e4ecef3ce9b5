"""Tokens, BM25 index tables and BM25 search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.blocks import CELLS, Nearest, best_rows, per_block

# Fixed values of Okapi BM25: saturation, length weight, share of the mean idf given to negative idfs.
K1, B, EPSILON = 1.5, 0.75, 0.25

QUERY_BLOCK = 1024  # queries whose term weights are sent to the tasks together
_HIT = "query_id long, item_id long, score double"
_COUNTED = "struct<dl:int,counts:array<struct<term:string,tf:int>>>"
_COUNTED_ROWS = 256  # texts whose tokens a task holds at once
_NO_TOKEN = tx.TOKEN.replace("[", "[^")


def tokenize(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per token: (id, pos, term).

    An inner explode would make Spark cut the text twice, once to filter.
    """
    return df.select(id_col, F.posexplode_outer(tx.tokens(F.col(text_col))).alias("pos", "term")).filter("term is not null")


def _counted(texts: pa.Array) -> pa.Array:
    """(dl, counts) of lower-cased texts: their number of tokens, and their terms in order with how often each occurs."""
    parts = pc.split_pattern_regex(texts, _NO_TOKEN)
    words = parts.flatten()
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # a text may begin and end with no token
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())[filled]
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    several = max(len(order), 1)
    met, tf = np.unique(row * several + place[coded.indices.to_numpy()][filled], return_counts=True)
    terms = coded.dictionary.take(pa.array(order[met % several]))
    ends = pa.array(np.searchsorted(met // several, np.arange(len(texts) + 1)), pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([terms, pa.array(tf, pa.int32())], ["term", "tf"]))
    return pa.StructArray.from_arrays([pa.array(np.bincount(row, minlength=len(texts)), pa.int32()), lists], ["dl", "counts"])


def _counted_udf():
    @F.arrow_udf(_COUNTED)
    def of(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_counted(texts.slice(at, _COUNTED_ROWS)) for at in range(0, max(len(texts), 1), _COUNTED_ROWS)])

    return of


def forward_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """(item_id, dl, counts array<(term, tf)>) for non-empty chunks, made inside each row; ``keep`` names further columns.

    Spark lower-cases the texts; a small Arrow function counts the tokens of each.
    """
    return (
        chunks.filter(F.length(text_col) > 0)
        .select(*keep, F.col(id_col).cast("long").alias("item_id"), _counted_udf()(F.lower(text_col)).alias("_w"))
        .select(*keep, "item_id", "_w.dl", "_w.counts")
    )


def term_table(index: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, cf, idf) of all terms."""
    df = (
        index.select(F.explode("counts").alias("c"))
        .groupBy(F.col("c.term").alias("term"))
        .agg(F.count("*").alias("df"), F.sum("c.tf").alias("cf"))
    )
    return with_idf(df, n_docs)


def with_idf(terms: DataFrame, n_docs: int) -> DataFrame:
    n = F.lit(float(n_docs))
    d = F.col("df").cast("double")
    return terms.withColumn("idf", F.log(n - d + F.lit(0.5)) - F.log(d + F.lit(0.5)))


def mean_idf(terms: DataFrame) -> float:
    return float(terms.agg(F.avg("idf")).first()[0] or 0.0)


def with_floor(terms: DataFrame, mean: float) -> DataFrame:
    """Add ``weight_idf``: the idf, or a share of the mean idf of all terms where it is negative."""
    floor = F.lit(EPSILON * mean)
    return terms.withColumn("weight_idf", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))


def corpus_numbers(index: DataFrame) -> tuple[int, float]:
    row = index.agg(F.count("*").alias("n"), F.avg(F.col("dl").cast("double")).alias("avgdl")).first()
    return int(row["n"]), float(row["avgdl"] or 0.0)


def bm25_index(index: DataFrame) -> tuple[DataFrame, int, float]:
    """Term table with floored idf, number of chunks and mean chunk length of a forward index."""
    n_docs, avgdl = corpus_numbers(index)
    terms = term_table(index, n_docs)
    return with_floor(terms, mean_idf(terms)), n_docs, avgdl


def postings(index: DataFrame) -> DataFrame:
    """(term, item_id, tf) rows."""
    return index.select("item_id", F.explode("counts").alias("c")).select("c.term", "item_id", "c.tf")


def query_weights(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term, weight) of query terms known to the corpus; a repeated term weighs each time."""
    wanted = (
        queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tx.term_counts(tx.tokens(F.col("text")))).alias("c"))
        .select("query_id", "c.term", F.col("c.tf").alias("qtf"))
    )
    return wanted.join(terms.select("term", "weight_idf"), "term").select(
        "query_id", "term", (F.col("qtf") * F.col("weight_idf")).alias("weight")
    )


def index_numbers(index: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """One row (n, avgdl, mean_idf), to be kept beside an index so that no search counts it again.

    ``terms`` is the index's term table; without it the terms are counted here.
    """
    n_docs, avgdl = corpus_numbers(index)
    mean = mean_idf(term_table(index, n_docs) if terms is None else terms)
    return index.sparkSession.createDataFrame([(n_docs, avgdl, mean)], "n long, avgdl double, mean_idf double")


def bm25_search(queries: DataFrame, index: DataFrame, terms: DataFrame, avgdl: float, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Best ``k`` chunks per query with a positive score: (query_id, item_id, raw_score, score, rank).

    ``score`` is the share of the query's best raw score. A block of queries
    goes to the tasks as its term weights; every task meets the terms of its own
    chunks with them and keeps ``k`` chunks per query.
    """
    def search(sent: Broadcast) -> DataFrame:
        return best_rows(_scored(index, sent, avgdl, k), k, F.round("score", 9).desc(), F.col("item_id"))

    hits = per_block(query_weights(queries, terms), "query_id", query_block, _by_term, search)
    best = F.max("score").over(Window.partitionBy("query_id"))
    hits = hits.withColumn("best", best).filter(F.col("score") > 0)
    return hits.select("query_id", "item_id", F.col("score").alias("raw_score"), (F.col("score") / F.col("best")).alias("score"), "rank")


def _by_term(weights: pa.Table) -> dict:
    """The weights of a block, term by term: the queries that hold it and what it weighs there."""
    texts = weights["term"].combine_chunks() if weights.num_rows else pa.array([], pa.string())
    term = texts.dictionary_encode()
    ids, at = np.unique(weights["query_id"].to_numpy(), return_inverse=True)
    of_term = term.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(of_term, kind="stable")
    held = np.bincount(of_term, minlength=len(term.dictionary))
    return {"terms": term.dictionary, "ids": ids, "held": held, "starts": np.cumsum(held) - held, "query": at[order], "weight": weights["weight"].to_numpy()[order]}


def _scored(index: DataFrame, sent, avgdl: float, k: int) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        if not len(w["ids"]):
            return
        best = Nearest(len(w["ids"]), k)
        everyone = np.arange(len(w["ids"]))
        for batch in batches:
            for ids, got in _batch_scores(batch, w, avgdl, best):
                best.add(everyone, ids, np.where(got == 0.0, np.inf, -got))
        yield best.batch(w["ids"], "score", -1.0)

    return index.mapInArrow(score, _HIT)


def _batch_scores(batch: pa.RecordBatch, w: dict, avgdl: float, best: Nearest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (chunk ids, queries x chunks scores) for slices of one Arrow batch.

    Only terms that both sides hold are touched: each meets the queries that
    hold it, and the products are summed into the slice's matrix.
    """
    sizes = pc.fill_null(pc.list_value_length(batch.column("counts")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    lo = 0
    while lo < batch.num_rows:
        # So many chunks that their terms do not pass the bound; one chunk at least.
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CELLS, side="right")) - 1)
        yield from _slice_scores(batch.slice(lo, hi - lo), sizes[lo:hi], w, avgdl, best)
        lo = hi


def _slice_scores(batch: pa.RecordBatch, sizes: np.ndarray, w: dict, avgdl: float, best: Nearest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    flat = batch.column("counts").flatten()
    row = np.repeat(np.arange(batch.num_rows), sizes)
    term = pc.fill_null(pc.index_in(flat.field("term"), value_set=w["terms"]), -1).to_numpy(zero_copy_only=False)
    tf = flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
    known = term >= 0
    row, term, tf = row[known], term[known], tf[known]
    dl = batch.column("dl").to_numpy(zero_copy_only=False).astype(np.float64)[row]
    part = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avgdl))
    n_q = len(w["ids"])
    products = np.bincount(row, weights=w["held"][term], minlength=batch.num_rows)
    before = np.concatenate([[0], np.cumsum(products)])
    ids = batch.column("item_id").to_numpy(zero_copy_only=False)
    lo = 0
    while lo < batch.num_rows:
        # So many chunks that neither their matrix nor their products pass the bound; one chunk at least.
        few = best.step(batch.num_rows - lo, max(1, CELLS // n_q))
        hi = min(lo + few, max(lo + 1, int(np.searchsorted(before, before[lo] + CELLS, side="right")) - 1))
        a, b = np.searchsorted(row, [lo, hi])
        held = w["held"][term[a:b]]
        inside = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        at = np.repeat(w["starts"][term[a:b]], held) + inside
        cell = w["query"][at] * (hi - lo) + np.repeat(row[a:b], held) - lo
        got = np.bincount(cell, weights=np.repeat(part[a:b], held) * w["weight"][at], minlength=(hi - lo) * n_q)
        yield ids[lo:hi], got.reshape(n_q, hi - lo)
        best.seen += hi - lo
        lo = hi
