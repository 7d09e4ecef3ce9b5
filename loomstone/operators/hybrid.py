"""Hybrid retrieval: dense and lexical search over one corpus, fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.vectors import nearness
from loomstone.operators import fusion as fu
from loomstone.operators import lexical as lx
from loomstone.plans.blocks import nearest
from loomstone.plans.ordered import top_rows


def item_facts(chunks: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(item_id, text_key, chars, ...) of every chunk: what hits need to know of a text without carrying it."""
    return chunks.select(F.col(id_col).cast("long").alias("item_id"), fu.text_key(F.col(text_col)).alias("text_key"), F.length(text_col).alias("chars"), *more)


def dense_hits(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Nearest items of (query_id, vector) questions among (item_id, vector), scored by nearness."""
    return nearest(questions, vectors, k).withColumn("score", nearness(F.col("distance")))


def both_sides(questions: DataFrame, index: DataFrame, terms: DataFrame, avgdl: float, vectors: DataFrame, facts: DataFrame, fetch: int) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical hits of (query_id, text, vector) questions with their text keys; a null vector has lexical hits only."""
    keys = facts.select("item_id", "text_key")
    dense = dense_hits(questions.select("query_id", "vector"), vectors, fetch)
    lexical = lx.bm25_search(questions.select("query_id", "text"), index, terms, avgdl, fetch)
    return dense.join(keys, "item_id"), lexical.join(keys, "item_id")


def hybrid_search(
    questions: DataFrame, index: DataFrame, terms: DataFrame, avgdl: float, vectors: DataFrame, facts: DataFrame, k: int = fu.TOP_K, fetch: int | None = None
) -> DataFrame:
    """Both searches fetch ``fetch`` items (four times the cut), are fused and cut to ``k``; ``place`` orders by score.

    Gives the columns of ``rrf_fuse`` with ``rank``, the fused rank, and ``place``.
    """
    dense, lexical = both_sides(questions, index, terms, avgdl, vectors, facts, fetch or k * fu.FETCH_TIMES)
    fused = fu.rrf_fuse(dense, lexical, k).withColumnRenamed("rank", "cut_rank")
    placed = top_rows(fused, ["query_id"], [F.round("score", 9).desc(), F.col("cut_rank")], k, "place")
    return placed.withColumnRenamed("cut_rank", "rank")
