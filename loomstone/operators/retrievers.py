"""Retrievers by name behind one contract.

A retriever maps (questions, corpus, k) to hits (query_id, item_id, rank,
score): at most ``k`` per question, ranked from 1 without gaps, each item once,
scores not rising with the rank. ``retrieve`` checks columns and types before
anything runs; ``broken_ranks`` finds the questions whose hits break a rule.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators import lexical as lx
from loomstone.operators.hybrid import dense_hits, hybrid_search

HITS = {"query_id": "bigint", "item_id": "bigint", "rank": "int", "score": "double"}


class Corpus(NamedTuple):
    """What the retrievers search: lexical index, its terms and mean length, (item_id, vector), and facts of every item."""

    index: DataFrame
    terms: DataFrame
    avgdl: float
    vectors: DataFrame
    facts: DataFrame


Retriever = Callable[[DataFrame, Corpus, int], DataFrame]
_NAMED: dict[str, Retriever] = {}


def retriever(name: str) -> Callable[[Retriever], Retriever]:
    """Register a function under a name; a name is given once."""

    def put(run: Retriever) -> Retriever:
        if name in _NAMED:
            raise ValueError(f"retriever {name!r} is there already")
        _NAMED[name] = run
        return run

    return put


def retriever_names() -> list[str]:
    return sorted(_NAMED)


def retrieve(name: str, questions: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    """Hits of a named retriever over (query_id, text, vector) questions, cut to the columns of the contract."""
    if name not in _NAMED:
        raise KeyError(f"no retriever {name!r}; there are {', '.join(retriever_names())}")
    if k < 1:
        raise ValueError("k is at least 1")
    found = _NAMED[name](questions, corpus, k)
    types = dict(found.dtypes)
    wrong = [f"{c} is {types.get(c, 'missing')}, not {t}" for c, t in HITS.items() if types.get(c) != t]
    if wrong:
        raise TypeError(f"hits of {name!r}: " + "; ".join(wrong))
    return found.select(*HITS)


def broken_ranks(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, rule) of hits that break the contract: ``gap``, ``repeated_item``, ``too_many``, ``score_rises`` or ``null``.

    One aggregation by question over at most ``k`` small rows each; scores are
    compared after rounding to nine digits.
    """
    some_null = F.greatest(*[F.col(c).isNull() for c in HITS])
    by_rank = F.array_sort(F.collect_list(F.struct("rank", F.round("score", 9).alias("score"))))
    sums = hits.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last"), F.min("rank").alias("first"), F.count_distinct("rank").alias("ranks"),
        F.count_distinct("item_id").alias("items"), F.max(some_null).alias("null"), by_rank["score"].alias("scores"),
    )
    n = F.col("n")
    falls = F.forall(F.sequence(F.lit(1), F.size("scores")), lambda i: (i == 1) | (F.get("scores", i - 2) >= F.get("scores", i - 1)))
    rules = {
        "gap": (F.col("first") != 1) | (F.col("last") != n) | (F.col("ranks") != n), "repeated_item": F.col("items") != n,
        "too_many": n > k, "score_rises": ~falls, "null": F.col("null"),
    }
    told = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return sums.select("query_id", F.explode(told).alias("rule"))


@retriever("dense")
def _dense(questions: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    return dense_hits(questions.select("query_id", "vector"), corpus.vectors, k)


@retriever("lexical")
def _lexical(questions: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    return lx.bm25_search(questions.select("query_id", "text"), corpus.index, corpus.terms, corpus.avgdl, k)


@retriever("hybrid")
def _hybrid(questions: DataFrame, corpus: Corpus, k: int) -> DataFrame:
    return hybrid_search(questions, *corpus, k).drop("rank").withColumnRenamed("place", "rank")
