"""Registry of the queries over the given tables and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import fusion as fu
from loomstone.operators import hybrid as hy
from loomstone.operators import lexical as lx
from loomstone.plans.spread import spread
from loomstone.session import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Tables whose rows carry texts that operators work on for long.
HEAVY = ["documents", "pages", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = source(sf_dir, name)
    df = spark.read.parquet(path)
    return spread(df, path) if name in HEAVY else df


def source(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"



WS_SQL = quoted(tx.WHITESPACE)
BREAK_SQL = quoted(tx.LINE_BREAK)


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def squeeze_sql(x: str) -> str:
    return f"regexp_replace({x}, {quoted(tx.WS + '+')}, '', 'g')"


def paragraphs_sql(x: str) -> str:
    split = f"regexp_split_to_array({x}, {quoted(chr(10) + tx.WS + '*' + chr(10))})"
    return f"list_filter(list_transform({split}, lambda p: {strip_sql('p')}), lambda p: p <> '')"


# ---------------------------------------------------------------- documents as chunks, benchmark as questions


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", "source")


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_index(spark, sf_dir):
    """Forward index, term table and mean length of the documents, written once per application; terms are counted once."""
    of = [source(sf_dir, "documents")]
    index = staged(spark, "forward_index", of, lambda: lx.forward_index(chunks(spark, sf_dir)))
    terms = staged(spark, "term_table", of, lambda: lx.term_table(index, lx.corpus_numbers(index)[0]))
    numbers = staged(spark, "index_numbers", of, lambda: lx.index_numbers(index, terms)).first()
    return index, lx.with_floor(terms, numbers["mean_idf"]), numbers["n"], numbers["avgdl"]


def lexical_hits(spark, sf_dir, queries: DataFrame, k: int) -> DataFrame:
    index, terms, _, avgdl = lexical_index(spark, sf_dir)
    return lx.bm25_search(queries, index, terms, avgdl, k)


INDEX_SQL = f"""
docs AS (SELECT doc_id AS item_id, text, regexp_extract_all(lower(text), '{tx.TOKEN}') AS words
         FROM documents WHERE length(text) > 0),
tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(words) AS term FROM docs) GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(CAST(len(words) AS DOUBLE)) AS avgdl FROM docs),
raw_terms AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
                ln(any_value(n) - count(*) + 5e-1) - ln(count(*) + 5e-1) AS idf
              FROM tf, corpus GROUP BY term),
terms AS (SELECT *, CASE WHEN idf < 0 THEN 25e-2 * (SELECT avg(idf) FROM raw_terms) ELSE idf END AS weight_idf FROM raw_terms)"""


def bm25_sql(queries: str, k: int, prefix: str = "lex") -> str:
    """CTEs up to ``<prefix>(query_id, item_id, raw_score, score, rank)`` for a (query_id, text) relation."""
    return f"""
{prefix}_q AS (SELECT query_id, term, count(*) AS qtf
               FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '{tx.TOKEN}')) AS term FROM {queries}) GROUP BY ALL),
{prefix}_s AS (SELECT query_id, item_id,
                 sum(qtf * weight_idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * len(words) / avgdl))) AS raw_score
               FROM {prefix}_q JOIN terms USING (term) JOIN tf USING (term) JOIN docs USING (item_id), corpus GROUP BY ALL),
{prefix}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw_score, 9) DESC, item_id) AS rank FROM {prefix}_s),
{prefix} AS (SELECT query_id, item_id, raw_score, raw_score / max(raw_score) OVER (PARTITION BY query_id) AS score, rank
             FROM {prefix}_r WHERE rank <= {k} AND raw_score > 0)"""


QUESTIONS_SQL = "(SELECT item_id AS query_id, text FROM benchmark)"


# ---------------------------------------------------------------- both sides over one corpus: the vector with a document's id is
# the vector of its text, the vector with a question's id is the vector of the question

FETCH = fu.TOP_K * fu.FETCH_TIMES


def facts(spark, sf_dir) -> DataFrame:
    """Digest, length, language and source of every document, written once, so that no text moves with a hit."""
    return staged(spark, "item_facts", [source(sf_dir, "documents")], lambda: hy.item_facts(chunks(spark, sf_dir), "chunk_id", "content", "lang", "source"))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def question_vectors(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return questions(spark, sf_dir).join(v, "query_id", "left")


def item_vectors(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return facts(spark, sf_dir).filter("chars > 0").select("item_id").join(v, "item_id")


def searched(spark, sf_dir) -> tuple:
    """What both searches look in: forward index, terms, mean length, vectors, facts."""
    index, terms, _, avgdl = lexical_index(spark, sf_dir)
    return index, terms, avgdl, item_vectors(spark, sf_dir), facts(spark, sf_dir)


VEC_SQL = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
L2_SQL = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
DENSE_SQL = f"""{VEC_SQL},
dense_d AS (SELECT q.item_id AS query_id, c.item_id, (SELECT 1) AS one, {L2_SQL} AS distance
            FROM benchmark q JOIN vecs a ON a.vec_id = q.item_id, docs c JOIN vecs b ON b.vec_id = c.item_id),
dense_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), item_id) AS rank FROM dense_d),
dense AS (SELECT query_id, item_id, 1e0 / (1e0 + distance) AS score, rank FROM dense_r WHERE rank <= {{fetch}})"""


def sides_sql(fetch: int) -> str:
    return f"""{INDEX_SQL}, {bm25_sql(QUESTIONS_SQL, fetch)}, {DENSE_SQL.format(fetch=fetch)},
sides AS (SELECT s.*, sha256(d.text) AS text_key
          FROM (SELECT query_id, item_id, rank, score, 0 AS side FROM dense
                UNION ALL SELECT query_id, item_id, rank, score, 1 AS side FROM lex) s JOIN documents d ON d.doc_id = s.item_id)"""


def fused_sql(rrf_k, carry, name="fused", src="sides", by="query_id", k=fu.TOP_K):
    stands = (
        "coalesce(max_by(item_id, rank) FILTER (side = 0), min_by(item_id, rank) FILTER (side = 1))" if carry
        else "coalesce(max_by(item_id, rank) FILTER (side = 1), max_by(item_id, rank) FILTER (side = 0))"
    )
    return f"""
{name}_g AS (SELECT {by}, text_key, sum(1e0 / ({rrf_k}e0 + rank)) AS rrf, avg(score) AS score,
               min(rank) FILTER (side = 0) AS dense_rank, min(rank) FILTER (side = 1) AS lexical_rank, {stands} AS item_id
             FROM {src} GROUP BY {by}, text_key),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}
             ORDER BY round(rrf, 9) DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST) AS rank FROM {name}_g) WHERE rank <= {k})"""


# ---------------------------------------------------------------- a hit table for the operators that work on hits

HITS_K = 20


def hits(spark, sf_dir, content: bool = True) -> DataFrame:
    """Fused hits of every benchmark question with the attributes of the hit document; raw_score is a hundred times the score.

    The hits are kept as ids; texts join them only where an operator reads texts.
    """

    def build():
        found = hy.hybrid_search(question_vectors(spark, sf_dir), *searched(spark, sf_dir), k=HITS_K, fetch=HITS_K)
        known = facts(spark, sf_dir).select("item_id", "lang", F.col("source").alias("doc_topic"))
        return found.select("query_id", "item_id", (F.col("score") * 100).alias("raw_score"), "score", "rank").join(known, "item_id")

    found = staged(spark, "question_hits", [source(sf_dir, t) for t in ("documents", "benchmark", "embeddings")], build)
    return found.join(chunks(spark, sf_dir).select(F.col("chunk_id").alias("item_id"), "content"), "item_id") if content else found


HITS_SQL = f"""{sides_sql(HITS_K)}, {fused_sql(fu.RRF_K, True, "fused_hits", k=HITS_K)},
hits AS (SELECT h.query_id, h.item_id, h.score * 100 AS raw_score, h.score, h.rank, d.text AS content, d.lang, d.source AS doc_topic FROM fused_hits h JOIN documents d ON d.doc_id = h.item_id)"""
