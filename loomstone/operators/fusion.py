"""Rank fusion, pooling, neighbour expansion, grading and context building over hit tables.

A hit table has one row per (query_id, hit) with ``rank`` from 1 and ``score`` in [0, 1].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions.vectors import sigmoid
from loomstone.plans.ordered import top_rows

# Fixed values of the retrieval stage.
RRF_K, RRF_K_V1, RERANK_K = 3, 60, 60
TOP_K, FETCH_TIMES, FINAL_K = 20, 4, 20
POOL_BONUS = 0.05
SIBLING_SCORE, SIBLING_SHARE = 0.5, 0.9
TOPIC_BONUS = 0.15
RELEVANT, PARTIAL = 0.5, 0.3
MAX_REWRITES, MAX_RETRIES = 1, 2
CONTEXT_CHARS, CONTEXT_CHARS_V1 = 1500, 1200
AVOID_TERMS = 8
MULTI_QUERY_TYPES = ["reasoning", "comparison", "list_n"]


def text_key(col: Column) -> Column:
    """Digest that stands for a text as a grouping key, so that shuffles carry 64 bytes and not the text."""
    return F.sha2(col, 256)


def rrf_fuse(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K, carry_score: bool = True) -> DataFrame:
    """Fuse two ranked lists of (query_id, item_id, text_key, rank, score) by reciprocal rank, keyed on the text.

    Equal texts add up. The cut to ``k`` is by fused rank; the score carried on
    is the mean of the scores that met in the text. With ``carry_score`` the
    dense item stands for the text, else the lexical one does.
    """
    cols = ["query_id", "item_id", "text_key", "rank", "score"]
    both = dense.select(*cols, F.lit(0).alias("side")).unionByName(lexical.select(*cols, F.lit(1).alias("side")))
    d, x = F.col("side") == 0, F.col("side") == 1
    last_dense = F.max_by(F.when(d, F.col("item_id")), F.when(d, F.col("rank")))
    first_lexical = F.min_by(F.when(x, F.col("item_id")), F.when(x, F.col("rank")))
    last_lexical = F.max_by(F.when(x, F.col("item_id")), F.when(x, F.col("rank")))
    stands = F.coalesce(last_dense, first_lexical) if carry_score else F.coalesce(last_lexical, last_dense)
    fused = both.groupBy("query_id", "text_key").agg(
        F.sum(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col("rank"))).alias("rrf"),
        F.avg("score").alias("score"),
        F.min(F.when(d, F.col("rank"))).alias("dense_rank"),
        F.min(F.when(x, F.col("rank"))).alias("lexical_rank"),
        stands.alias("item_id"),
    )
    order = [F.round("rrf", 9).desc(), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank")]
    fused = top_rows(fused, ["query_id"], order, k)
    keep = ["query_id", "item_id", "text_key", "rrf", "rank", "dense_rank", "lexical_rank"]
    return fused.select(*keep, "score") if carry_score else fused.select(*keep)


def multi_query_pool(hits: DataFrame, k: int = TOP_K, bonus: float = POOL_BONUS) -> DataFrame:
    """Pool the hits of several variants of a question.

    ``hits`` is (query_id, variant, rank, item_id, text_key, score). A text met
    again takes the higher score plus a bonus, at most 1; the order in which
    its scores arrive matters. The pool is cut to ``k`` by score, earlier
    texts first on ties.
    """
    seen = F.array_sort(F.collect_list(F.struct("variant", "rank", "score", "item_id")))
    pooled = hits.groupBy("query_id", "text_key").agg(seen.alias("seen"))
    score = F.aggregate(
        F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(0))),
        F.col("seen")[0]["score"],
        lambda best, x: F.least(F.lit(1.0), F.greatest(best, x["score"]) + F.lit(bonus)),
    )
    pooled = pooled.select(
        "query_id",
        "text_key",
        F.element_at("seen", -1)["item_id"].alias("item_id"),
        F.size("seen").alias("times"),
        F.col("seen")[0]["variant"].alias("first_variant"),
        F.col("seen")[0]["rank"].alias("first_rank"),
        score.alias("score"),
    )
    return top_rows(pooled, ["query_id"], [F.round("score", 9).desc(), F.col("first_variant"), F.col("first_rank")], k)


def expand_same_page(hits: DataFrame, chunks: DataFrame, mode: str = "append") -> DataFrame:
    """Add the chunks of the hits' pages, and chunks whose parent is such a page.

    ``hits`` is (query_id, rank, score, chunk_id, doc_id, page, parent_page,
    text_key) and ``chunks`` is (doc_id, chunk_id, page, parent_page, content,
    pos), ``pos`` being the order in the store. Only texts on the hits' pages
    are digested. ``append`` puts siblings at the end
    with a fixed score; ``inline`` puts them behind their hit with a share of
    its score; ``off`` returns the hits. A text already among the hits is not
    added, and each text is added once, at its first place.
    """
    cols = ["query_id", "chunk_id", "text_key", "score", "is_sibling"]
    at_hit = F.struct(F.col("rank"), F.lit(-1).alias("via"), F.lit(-1).alias("kind"), F.lit(-1).cast("long").alias("pos"))
    own = hits.select(*cols[:-1], F.lit(False).alias("is_sibling"), at_hit.alias("place"))
    if mode == "off":
        return own
    pages = F.array(
        F.struct(F.lit(0).alias("via"), F.col("page").alias("at")), F.struct(F.lit(1).alias("via"), F.col("parent_page").alias("at"))
    )
    wanted = hits.select("query_id", "rank", "score", "doc_id", F.explode(pages).alias("p"))
    wanted = wanted.select("query_id", "rank", "score", "doc_id", "p.via", F.col("p.at").alias("at")).filter("at is not null")
    # A page reached by several hits counts at its first hit, so each page joins once per query.
    first = F.min_by(F.struct("rank", "via", "score"), F.struct("rank", "via"))
    wanted = wanted.groupBy("query_id", "doc_id", "at").agg(first.alias("f"))
    on_page = chunks.select(
        "doc_id",
        F.col("chunk_id").alias("sib_id"),
        "content",
        "pos",
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("page").alias("at")), F.struct(F.lit(1).alias("kind"), F.col("parent_page").alias("at")))).alias("p"),
    ).select("doc_id", "sib_id", "content", "pos", "p.kind", F.col("p.at").alias("at")).filter("at is not null")
    place = F.struct(F.col("f.rank").alias("rank"), F.col("f.via").alias("via"), F.col("kind"), F.col("pos"))
    found = (
        wanted.join(on_page, ["doc_id", "at"])
        .groupBy("query_id", text_key(F.col("content")).alias("text_key"))
        .agg(F.min_by(F.struct(place.alias("place"), F.col("sib_id").alias("chunk_id"), F.col("f.score").alias("parent")), place).alias("s"))
        .join(hits.select("query_id", "text_key").distinct(), ["query_id", "text_key"], "left_anti")
    )
    given = F.lit(SIBLING_SCORE) if mode == "append" else F.col("s.parent") * F.lit(SIBLING_SHARE)
    found = found.select(
        "query_id", F.col("s.chunk_id").alias("chunk_id"), "text_key", given.alias("score"), F.lit(True).alias("is_sibling"),
        F.col("s.place").alias("place"),
    )
    return own.unionByName(found)


def expanded_order(mode: str = "append") -> list[Column]:
    """Order of an expanded hit table, for ``top_rows``: siblings last, or each behind its hit."""
    place = [F.col("place.rank"), F.col("place.via"), F.col("place.kind"), F.col("place.pos")]
    return [F.col("is_sibling"), *place] if mode == "append" else place


def topic_boost(hits: DataFrame, bonus: float = TOPIC_BONUS) -> DataFrame:
    """Raise hits whose topic is the query's, at most to 1, and rank anew; ties keep their old order."""
    same = F.col("doc_topic") == F.col("query_topic")
    score = F.when(same, F.least(F.lit(1.0), F.col("score") + F.lit(bonus))).otherwise(F.col("score"))
    return _rerank(hits.withColumn("score", score), [F.round("score", 9).desc(), F.col("rank")])


def _rerank(hits: DataFrame, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("new_rank", place).withColumn("rank", F.col("new_rank")).drop("new_rank")


def final_cut(hits: DataFrame, k: int = FINAL_K) -> DataFrame:
    return top_rows(hits.withColumnRenamed("rank", "old_rank"), ["query_id"], [F.col("old_rank")], k).drop("old_rank")


def title_case(text: Column) -> Column:
    """Every run of letters with its first letter upper and the rest lower, as in ``Slide_Subchunk``."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1), F.initcap), "")


def hit_location(unit_type: Column, unit_index: Column, unit_title: Column, page_number: Column, chunk_index: Column) -> Column:
    """Where a hit stands: ``Slide 3 — title``, ``Page n`` or ``Chunk n``."""
    head = F.concat(title_case(F.coalesce(unit_type, F.lit("page"))), F.lit(" "), unit_index.cast("string"))
    titled = F.when(F.coalesce(unit_title, F.lit("")) != "", F.concat(head, F.lit(" — "), unit_title)).otherwise(head)
    return (
        F.when(unit_index.isNotNull(), titled)
        .when(F.coalesce(page_number, F.lit(0)) != 0, F.concat(F.lit("Page "), page_number.cast("string")))
        .otherwise(F.concat(F.lit("Chunk "), F.coalesce(chunk_index, F.lit(0)).cast("string")))
    )


def hit_source(doc_id: Column, display_source: Column, title: Column) -> Column:
    """First non-empty of document, display name and title."""
    filled = [F.when(c != "", c) for c in (doc_id, display_source, title)]
    return F.coalesce(*filled, F.lit(""))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def grade_hits(hits: DataFrame, mode: str = "off", relevant: float = RELEVANT, partial: float = PARTIAL) -> DataFrame:
    """Grade by ``rerank_score``: ``off`` keeps every hit as relevant, ``replace`` and ``fuse`` drop weak hits and rank anew."""
    if mode == "off":
        return hits.withColumn("grade", F.lit("relevant"))
    s = F.col("rerank_score")
    graded = hits.withColumn("grade", F.when(s >= relevant, "relevant").when(s >= partial, "partial")).filter("grade is not null")
    graded = graded.withColumn("score", s)
    if mode == "replace":
        return _rerank(graded, [F.round("score", 9).desc(), F.col("rank")])
    return rerank_fuse(graded)


def rerank_fuse(hits: DataFrame, k: int = RERANK_K) -> DataFrame:
    """Order kept hits by the sum of reciprocal ranks of the old order and of the rerank order, both from 0."""
    by_score = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rank")
    fused = hits.withColumn("rerank_rank", F.row_number().over(by_score) - 1)
    total = F.lit(1.0) / (F.lit(k) + F.col("rank") - 1) + F.lit(1.0) / (F.lit(k) + F.col("rerank_rank"))
    fused = fused.withColumn("fused", total)
    return _rerank(fused, [F.round("fused", 12).desc(), F.col("rank")])


def coverage(queries: DataFrame, hits: DataFrame, relevant: float = RELEVANT, partial: float = PARTIAL) -> DataFrame:
    """Per query the number of hits, of relevant and kept ones, the best score and how well the hits cover it."""
    s = F.col("rerank_score")
    counted = hits.groupBy("query_id").agg(
        F.count("*").alias("total"),
        F.count_if(s >= relevant).alias("relevant"),
        F.count_if(s >= partial).alias("kept"),
        F.max(s).alias("max_score"),
    )
    out = queries.select("query_id").join(counted, "query_id", "left")
    zero = {"total": 0, "relevant": 0, "kept": 0, "max_score": 0.0}
    out = out.fillna(zero)
    cover = (
        F.when((F.col("total") == 0) | (F.col("max_score") < partial), "none").when(F.col("relevant") >= 2, "full").otherwise("partial")
    )
    return out.withColumn("coverage", cover)


def grade_route(covered: DataFrame, iterations: Column, limit: int = MAX_REWRITES) -> DataFrame:
    """Next step and trace label per query: rewrite while nothing was kept and the limit allows, else generate."""
    spent = iterations >= F.lit(limit)
    tail = F.concat(F.lit("total,max="), tx.two_digits(F.col("max_score")), F.lit(",cov="), F.col("coverage"), F.lit(")"))
    passed = F.format_string("grade:pass(%drel/%dkept/%d", "relevant", "kept", "total")
    label = (
        F.when(F.col("total") == 0, F.lit("grade:no_docs"))
        .when(F.col("kept") > 0, F.concat(passed, tail))
        .when(spent, F.concat(F.format_string(f"grade:exhausted_after_{limit}rewrites(0rel/%d", "total"), tail))
        .otherwise(F.concat(F.format_string("grade:all_irrelevant(0rel/%d", "total"), tail))
    )
    route = F.when((F.col("kept") == 0) & ~spent, "rewrite").otherwise("generate")
    return covered.withColumn("label", label).withColumn("route", route)


def extraneous_terms(hits: DataFrame, queries: DataFrame, k: int = AVOID_TERMS) -> DataFrame:
    """Entities of the hits that the question lacks: first ``k`` in order and their number.

    ``hits`` is (query_id, entities) and ``queries`` (query_id, entities), both arrays.
    """
    of_hits, of_query = (
        df.select("query_id", F.explode_outer("entities").alias("e")).filter("e is not null").select("query_id", F.lower("e").alias("e"))
        for df in (hits, queries)
    )
    of_hits = of_hits.distinct()
    extra = of_hits.join(of_query, ["query_id", "e"], "left_anti")
    counted = extra.groupBy("query_id").agg(F.count("*").alias("extraneous"))
    first = top_rows(extra, ["query_id"], [F.col("e")], k).groupBy("query_id")
    first = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e"))), lambda x: x["e"]), ", ").alias("avoid"))
    out = queries.select("query_id").join(counted, "query_id", "left").join(first, "query_id", "left")
    return out.fillna({"extraneous": 0, "avoid": ""})


def hit_topics(hits: DataFrame) -> DataFrame:
    """Distinct topics of a query's hits other than ``general``, one row each."""
    return hits.filter((F.col("doc_topic") != "general") & (F.col("doc_topic") != "")).select("query_id", "doc_topic").distinct()


def build_context(hits: DataFrame, chars: int = CONTEXT_CHARS, page_style: bool = False) -> DataFrame:
    """Numbered blocks of a query's hits joined to one text; the hits of a query are at most its final cut."""
    if page_style:
        place = F.when(F.coalesce(F.col("location"), F.lit("")) != "", F.concat(F.lit(" (p."), F.col("location"), F.lit(")")))
        body = F.left(tx.strip(F.col("content")), F.lit(chars))
    else:
        place = F.when(F.coalesce(F.col("location"), F.lit("")) != "", F.concat(F.lit(" "), F.col("location")))
        body = F.left("content", F.lit(chars))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.coalesce(place, F.lit("")), F.lit("\n"), body)
    blocks = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("b"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def sigmoid_score(hits: DataFrame, logit: str = "logit", query: str = "query_text") -> DataFrame:
    """Rerank logit as a score; an empty query scores 0."""
    return hits.withColumn("rerank_score", F.when(tx.blank(F.col(query)), F.lit(0.0)).otherwise(sigmoid(F.col(logit))))


def plan_queries(questions: DataFrame, variants: int = 2) -> DataFrame:
    """Queries to run per question: the question, and its variants where its type calls for several.

    ``questions`` is (query_id, text, resolved_query, question_type, variants array).
    """
    effective = tx.strip(F.coalesce(F.when(F.col("resolved_query") != "", F.col("resolved_query")), F.col("text")))
    kind = F.coalesce(F.when(F.col("question_type") != "", F.col("question_type")), F.lit("reasoning"))
    extra = F.slice(F.filter(F.transform("variants", tx.strip), lambda v: v != ""), 1, variants)
    wanted = F.when(kind.isin(MULTI_QUERY_TYPES), F.concat(F.array(effective), F.coalesce(extra, F.array().cast("array<string>")))).otherwise(F.array(effective))
    return questions.select("query_id", kind.alias("question_type"), F.posexplode(wanted).alias("variant", "query_text"))


def quality_check(queries: DataFrame, hits: DataFrame, limit: int = MAX_RETRIES) -> DataFrame:
    """Older loop: rewrite a query without hits until its retries are used up. ``queries`` has ``retry_count``."""
    found = hits.select("query_id").distinct().withColumn("found", F.lit(True))
    out = queries.join(found, "query_id", "left")
    ok = F.col("found").isNotNull() | (F.col("retry_count") >= limit)
    return out.select("query_id", "retry_count", ok.alias("quality_ok"), F.when(ok, "answer").otherwise("rewrite").alias("route"))


def clean_rewrite(raw: Column, original: Column) -> Column:
    """First line of a rewrite without quotes and ticks; an empty or unchanged one gives the original."""
    first = tx.strip(tx.lines(tx.strip(raw))[0])
    bare = tx.strip(F.btrim(first, F.lit("`\"'“”")))
    usable = (bare != "") & (bare != tx.strip(original))
    return F.when(F.coalesce(usable, F.lit(False)), bare).otherwise(original)
