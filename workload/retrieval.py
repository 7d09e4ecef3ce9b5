"""Lexical and dense search, fusion and the operators on hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions.vectors import nearness
from loomstone.operators import fusion as fu
from loomstone.operators import hybrid as hy
from loomstone.operators import lexical as lx
from loomstone.operators import lexical_store as ls
from loomstone.operators import retrievers as rt
from loomstone.plans.blocks import nearest
from loomstone.session import fresh_path
from workload.base import (
    FETCH, INDEX_SQL, L2_SQL, QUESTIONS_SQL, VEC_SQL, bm25_sql, facts, fused_sql, lexical_hits, lexical_index, query, question_vectors, questions,
    searched, sides_sql, table, vectors,
)

@query("tokenize", f"SELECT doc_id, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, unnest(words) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '{tx.TOKEN}') AS words FROM documents)")
def tokenize(spark, sf):
    return lx.tokenize(table(spark, sf, "documents"), "doc_id", "text")


@query("bm25_index", f"WITH {INDEX_SQL} SELECT term, df, cf, round(idf, 6) AS idf, round(weight_idf, 6) AS weight_idf, n, round(avgdl, 6) AS avgdl FROM terms, corpus")
def bm25_index(spark, sf):
    _, terms, n, avgdl = lexical_index(spark, sf)
    return terms.select(
        "term", "df", "cf", F.round("idf", 6).alias("idf"), F.round("weight_idf", 6).alias("weight_idf"),
        F.lit(n).cast("long").alias("n"), F.round(F.lit(avgdl), 6).alias("avgdl"),
    )


@query("bm25_postings", f"WITH {INDEX_SQL} SELECT term, item_id, CAST(tf AS INTEGER) AS tf FROM tf")
def bm25_postings(spark, sf):
    return lx.postings(lexical_index(spark, sf)[0])


@query("bm25_search", f"WITH {INDEX_SQL}, {bm25_sql(QUESTIONS_SQL, fu.TOP_K)} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(raw_score, 6) AS raw_score, round(score, 6) AS score FROM lex")
def bm25_search(spark, sf):
    found = lexical_hits(spark, sf, questions(spark, sf), fu.TOP_K)
    return found.select("query_id", "item_id", "rank", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- an index that grew by ingests


def grown(spark, sf):
    """A store after three ingests: all documents, German ones in an older wording, and the questions; then the questions
    go and German documents come as they are; then French documents come again. What is left is the documents."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", "source")
    asked = questions(spark, sf).select(F.concat(F.lit("question-"), F.col("query_id").cast("string")).alias("path"), (-F.col("query_id") - 1).alias("chunk_id"), F.col("text").alias("content"))
    older = docs.withColumn("content", F.when(F.col("lang") == "de", F.concat("source", F.lit(" "), "content")).otherwise(F.col("content")))
    first = older.select("path", "chunk_id", "content").unionByName(asked)
    store = fresh_path(spark, "lexical_store")
    ls.ingest(spark, store, first, first)
    german, french = docs.where("lang = 'de'"), docs.where("lang = 'fr'")
    ls.ingest(spark, store, asked.select("path").unionByName(german.select("path")), german)
    ls.ingest(spark, store, french, french)
    return store


@query("incremental_index", f"WITH {INDEX_SQL} SELECT term, df, cf, round(idf, 6) AS idf, round(weight_idf, 6) AS weight_idf, n, round(avgdl, 6) AS avgdl FROM terms, corpus")
def incremental_index(spark, sf):
    _, terms, n, avgdl = ls.open_index(spark, grown(spark, sf))
    return terms.select(
        "term", "df", "cf", F.round("idf", 6).alias("idf"), F.round("weight_idf", 6).alias("weight_idf"),
        F.lit(n).cast("long").alias("n"), F.round(F.lit(avgdl), 6).alias("avgdl"),
    )


@query("incremental_search", f"WITH {INDEX_SQL}, {bm25_sql(QUESTIONS_SQL, fu.TOP_K)} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(raw_score, 6) AS raw_score, round(score, 6) AS score FROM lex")
def incremental_search(spark, sf):
    """Search in the same store after its generations were folded into one."""
    store = grown(spark, sf)
    index, terms, _, avgdl = ls.open_index(spark, store, ls.compact(spark, store))
    found = lx.bm25_search(questions(spark, sf), index, terms, avgdl, fu.TOP_K)
    return found.select("query_id", "item_id", "rank", F.round("raw_score", 6).alias("raw_score"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- dense

@query("dense_search", f"""WITH {VEC_SQL},
d AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {L2_SQL} AS distance FROM vecs a, vecs b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), item_id) AS rank FROM d)
SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, round(1e0 / (1e0 + distance), 6) AS score FROM r WHERE rank <= {fu.TOP_K}""")
def dense_search(spark, sf):
    v = vectors(spark, sf)
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    c = v.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    near = nearest(q, c, fu.TOP_K, skip_same=True)
    return near.select("query_id", "item_id", "rank", F.round(nearness(F.col("distance")), 6).alias("score"))


def both_sides(spark, sf, k=FETCH):
    return hy.both_sides(question_vectors(spark, sf), *searched(spark, sf), k)


SIDES_SQL = sides_sql(FETCH)


def _fused_cols(df, *more):
    return df.select("query_id", "item_id", F.col("rank"), F.round("rrf", 6).alias("rrf"), "dense_rank", "lexical_rank", *more)


FUSED_SELECT = "query_id, item_id, CAST(rank AS INTEGER) AS rank, round(rrf, 6) AS rrf, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank"


@query("rrf_fuse", f"WITH {SIDES_SQL}, {fused_sql(fu.RRF_K, True)} SELECT {FUSED_SELECT}, round(score, 6) AS score FROM fused")
def rrf_fuse(spark, sf):
    dense, lex = both_sides(spark, sf)
    return _fused_cols(fu.rrf_fuse(dense, lex, fu.TOP_K), F.round("score", 6).alias("score"))


@query("rrf_fuse_v1", f"WITH {SIDES_SQL}, {fused_sql(fu.RRF_K_V1, False)} SELECT {FUSED_SELECT} FROM fused")
def rrf_fuse_v1(spark, sf):
    dense, lex = both_sides(spark, sf)
    return _fused_cols(fu.rrf_fuse(dense, lex, fu.TOP_K, fu.RRF_K_V1, carry_score=False))


@query("hybrid_search", f"""WITH {SIDES_SQL}, {fused_sql(fu.RRF_K, True)}
SELECT f.query_id, f.item_id, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.score, 9) DESC, f.rank) AS INTEGER) AS place,
       round(f.score, 6) AS score, d.lang, d.source, CAST(length(d.text) AS INTEGER) AS chars
FROM fused f JOIN documents d ON d.doc_id = f.item_id""")
def hybrid_search(spark, sf):
    """Both searches fetch four times the cut, are fused and cut; the order of what is left is by score."""
    placed = hy.hybrid_search(question_vectors(spark, sf), *searched(spark, sf))
    return placed.join(facts(spark, sf), "item_id").select("query_id", "item_id", "place", F.round("score", 6).alias("score"), "lang", "source", "chars")


# ---------------------------------------------------------------- retrievers by name


@query("retrieve", f"""WITH {SIDES_SQL}, {fused_sql(fu.RRF_K, True)}
SELECT CASE side WHEN 0 THEN 'dense' ELSE 'lexical' END AS retriever, query_id, item_id, CAST(rank AS INTEGER) AS rank FROM sides WHERE rank <= {fu.TOP_K}
UNION ALL SELECT 'hybrid', query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS INTEGER) FROM fused""")
def retrieve(spark, sf):
    """Every registered retriever over the same questions and corpus."""
    corpus, asked = rt.Corpus(*searched(spark, sf)), question_vectors(spark, sf)
    out = [rt.retrieve(n, asked, corpus, fu.TOP_K).select(F.lit(n).alias("retriever"), "query_id", "item_id", "rank") for n in rt.retriever_names()]
    return reduce(DataFrame.unionByName, out)
