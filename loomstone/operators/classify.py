"""Nearest-reference classification and the rules around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions.vectors import cosine, nearness
from loomstone.plans.blocks import best_per_class, nearest
from loomstone.plans.ordered import top_rows

# Thresholds, allowed routes and question kinds, trigger phrases.
TOP1_MIN, MARGIN_MIN, RANKED = 0.62, 0.08, 4
SINGLE_MIN, WINDOW_MIN = 0.80, 0.76
BYPASS_MIN, HINT_MIN = 0.92, 0.78
RELEVANCE_MIN, KEEP_LAST = 0.40, 0
FALLBACK_MIN = 0.7
GUIDE_CHARS, META_RESIDUAL, MAX_SUBS, RESOLVED_CHARS = 15, 6, 5, 300
TASKS = ["knowledge_search", "ai_guide", "file_chat", "detail_search"]
DECISIONS = ["no_retrieval", "single_retrieval", "multi_hop_retrieval", "ai_guide", "file_chat"]
QUESTION_TYPES = ["exact_phrase", "numerical", "list_n", "fill_blank", "reasoning", "comparison"]
DETAIL_HINTS = [
    "자세히", "자세하게", "더 알려줘", "좀 더", "구체적", "상세히", "상세하게",
    "더 설명", "추가로 설명", "자세한 내용", "더 자세한",
]
GUIDE_HINTS = [
    "안녕", "반가워", "뭐 할 수 있어", "무슨 기능", "도움말", "help",
    "소개해", "뭐야", "누구야", "어떤 ai", "기능 안내", "사용법",
]
GUIDE_TRIGGERS = [
    "안녕", "반가워", "도움말", "help", "소개", "기능 안내", "사용법",
    "어떤 기능", "뭘 할 수 있", "무엇을 할 수 있",
]
SELF_REFERENCES = [
    "너는", "너의", "너 뭐", "당신은", "당신이", "당신의", "이 시스템", "이 챗봇",
    "어시스턴트", "챗봇", "이 서비스", "여기서 뭘", "여기서 무엇",
]
FILE_WORDS = [
    "파일", "첨부", "업로드", "올린", "올려놓은", "업로드한", "첨부한",
    "file", "attach", "upload", "pdf", "엑셀", "워드", "ppt", "pptx", "docx", "xlsx",
]


def nearest_class_route(
    queries: DataFrame, references: DataFrame, top1_min: float = TOP1_MIN, margin_min: float = MARGIN_MIN, skip_same: bool = False, ranked: int = RANKED
) -> DataFrame:
    """Class of the nearest reference per query, ``-1`` for unknown where it is too far or too close to the next class.

    Gives (query_id, top1_class, top1_score, top2_score, margin, decision, ranked).
    """
    scored = best_per_class(queries, references, skip_same=skip_same)
    best = top_rows(scored, ["query_id"], [F.round("score", 9).desc(), F.col("class")], ranked)
    by_rank = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "class", "score"))),
        lambda x: F.struct(x["class"].alias("class"), x["score"].alias("score")),
    )
    out = best.groupBy("query_id").agg(by_rank.alias("ranked"))
    top1, top2 = F.col("ranked")[0], F.get("ranked", F.lit(1))
    out = out.select(
        "query_id", "ranked", top1["class"].alias("top1_class"), top1["score"].alias("top1_score"),
        F.coalesce(top2["score"], F.lit(-1.0)).alias("top2_score"),
    )
    out = out.withColumn("margin", F.col("top1_score") - F.col("top2_score"))
    unsure = (F.col("top1_score") < top1_min) | (F.col("margin") < margin_min)
    return out.withColumn("decision", F.when(unsure, F.lit(-1).cast("long")).otherwise(F.col("top1_class")))


def injection_screen(
    inputs: DataFrame,
    references: DataFrame,
    single_min: float = SINGLE_MIN,
    window_min: float = WINDOW_MIN,
    on_unavailable: str = "block",
) -> DataFrame:
    """Screen (query_id, text, vector, has_recent, window_vector) against reference vectors (item_id, vector).

    Three outcomes are kept apart: ``pass``, ``injection`` and ``unavailable``,
    where a vector that the verdict needs is missing; the last one blocks
    unless told otherwise. An empty input passes.
    """
    sides = F.array(F.struct(F.lit(0).alias("s"), F.col("vector").alias("v")), F.struct(F.lit(1).alias("s"), F.col("window_vector").alias("v")))
    asked = inputs.select("query_id", F.explode(sides).alias("x"))
    asked = asked.select((F.col("query_id") * 2 + F.col("x.s")).alias("query_id"), F.col("x.v").alias("vector"))
    scored = best_per_class(asked, references.withColumn("class", F.lit(0)))
    scored = scored.groupBy(F.floor(F.col("query_id") / 2).cast("long").alias("query_id")).agg(
        F.max(F.when(F.col("query_id") % 2 == 0, F.col("score"))).alias("single_score"),
        F.max(F.when(F.col("query_id") % 2 == 1, F.col("score"))).alias("window_score"),
    )
    out = inputs.select("query_id", tx.blank(F.col("text")).alias("empty"), "has_recent").join(scored, "query_id", "left")
    reason = (
        F.when(F.col("empty"), "empty_input")
        .when(F.col("single_score").isNull(), "unavailable")
        .when(F.col("single_score") >= single_min, "injection")
        .when(~F.col("has_recent"), "pass")
        .when(F.col("window_score").isNull(), "unavailable")
        .when(F.col("window_score") >= window_min, "injection")
        .otherwise("pass")
    )
    out = out.withColumn("reason", reason)
    blocks = ["injection", "unavailable"] if on_unavailable == "block" else ["injection"]
    return out.withColumn("blocked", F.col("reason").isin(blocks)).drop("empty")


def qa_cache_match(
    queries: DataFrame, cache: DataFrame, bypass_min: float = BYPASS_MIN, hint_min: float = HINT_MIN, skip_same: bool = False
) -> DataFrame:
    """Nearest cached question per query and the band its score falls in: (query_id, item_id, score, band)."""
    near = nearest(queries, cache, 1, skip_same=skip_same).withColumn("score", nearness(F.greatest(F.col("distance"), F.lit(0.0))))
    out = queries.select("query_id").join(near.select("query_id", "item_id", "score"), "query_id", "left")
    s = F.col("score")
    band = F.when(s >= bypass_min, "bypass").when(s >= hint_min, "hint").otherwise("miss")
    hit = band != "miss"
    return out.select("query_id", F.when(hit, F.col("item_id")).alias("item_id"), F.when(hit, s).alias("score"), band.alias("band"))


def qa_cache_apply(questions: DataFrame, matches: DataFrame, cache: DataFrame) -> DataFrame:
    """What a cache match changes.

    ``questions`` is (query_id, text, question_type, sub_questions), ``cache``
    (item_id, question, answer, doc_id, answer_type). A bypass answers with one
    citation, a hint puts the cached question in front of the sub-questions.
    """
    cached = cache.select("item_id", "question", "answer", F.col("doc_id").alias("cited_doc"), "answer_type")
    out = questions.join(matches, "query_id", "left").join(cached, "item_id", "left")
    band = F.coalesce("band", F.lit("miss"))
    asked = tx.strip(F.coalesce("text", F.lit("")))
    marked = F.when(F.contains("answer", F.lit("[1]")), F.col("answer")).otherwise(F.concat("answer", F.lit(" [1]")))
    subs = F.coalesce("sub_questions", F.array().cast("array<string>"))
    fresh = (F.coalesce("question", F.lit("")) != "") & ~F.array_contains(subs, F.col("question")) & (F.col("question") != asked)
    label = (
        F.when(asked == "", "qa_lookup:empty_query")
        .when(band == "miss", "qa_lookup:miss")
        .otherwise(F.concat(F.lit("qa_lookup:"), band, F.lit("("), tx.two_digits(F.col("score")), F.lit(")")))
    )
    hit = (asked != "") & (band != "miss")
    return out.select(
        "query_id",
        F.when(hit & (band == "bypass"), marked).alias("answer"),
        F.when(hit & (band == "bypass"), F.when(F.coalesce("cited_doc", F.lit("")) != "", F.col("cited_doc")).otherwise("qa_cache")).alias("cited_doc"),
        F.when(hit & F.coalesce(F.col("answer_type") != "", F.lit(False)), F.col("answer_type")).otherwise(F.col("question_type")).alias("question_type"),
        F.when(hit & (band == "hint") & fresh, F.concat(F.array("question"), subs)).otherwise(subs).alias("sub_questions"),
        label.alias("label"),
        F.when(hit & (band == "bypass"), "end").otherwise("retrieve").alias("route"),
    )


def history_relevance(pairs: DataFrame, current: DataFrame, min_cosine: float = RELEVANCE_MIN, keep_last: int = KEEP_LAST) -> DataFrame:
    """Pairs of (conv_id, turn, vector) near the current input (conv_id, input_vector), and the last ones in any case.

    Where the current input has no vector every pair is kept.
    """
    scored = pairs.join(current.select("conv_id", "input_vector"), "conv_id", "left")
    sim = F.when(F.col("input_vector").isNotNull(), cosine(F.col("input_vector"), F.coalesce("vector", F.array().cast("array<float>"))))
    scored = scored.withColumn("similarity", sim).drop("input_vector")
    near = F.col("similarity").isNull() | (F.col("similarity") >= min_cosine)
    if keep_last <= 0:
        return scored.filter(near)
    late = top_rows(pairs.select("conv_id", "turn"), ["conv_id"], [F.col("turn").desc()], keep_last).select("conv_id", "turn")
    late = late.withColumn("late", F.lit(True))
    return scored.join(late, ["conv_id", "turn"], "left").filter(near | F.col("late")).drop("late")


def unknown_fallback(task: Column, text: Column) -> Column:
    """Where a routed task goes; an unknown one goes to the guide if short or asking for it, else to search."""
    task = tx.strip(F.coalesce(F.when(task != "", task), F.lit("knowledge_search")))
    asked = tx.strip(F.coalesce(text, F.lit("")))
    guide = (F.length(asked) <= GUIDE_CHARS) | tx.contains_any(asked, GUIDE_HINTS)
    return (
        F.when(task == "chat", "knowledge_search")
        .when(task.isin("unknown", ""), F.when(guide, "ai_guide").otherwise("knowledge_search"))
        .when(task == "injection", "rejection")
        .when(task == "clarification", "clarification")
        .when(task.isin(TASKS), task)
        .otherwise("knowledge_search")
    )


def route_postchecks_v1(routed: Column, text: Column, previous_task: Column, has_messages: Column, has_file: Column) -> Column:
    """Corrections of the first router: follow-ups go to detail search, files decide what is still unknown."""
    routed = F.when(tx.blank(text), F.lit("knowledge_search")).otherwise(routed)
    follow = (
        routed.isin("unknown", "knowledge_search")
        & F.coalesce(tx.strip(previous_task).isin("knowledge_search", "detail_search"), F.lit(False))
        & has_messages
        & tx.contains_any(text, DETAIL_HINTS)
    )
    step = F.when(follow & ~tx.blank(text), F.lit("detail_search")).otherwise(routed)
    step = F.when((step == "unknown") & has_file, F.lit("file_chat")).otherwise(step)
    return F.when((step == "file_chat") & ~has_file, F.lit("clarification")).otherwise(step)


def _mentions(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def route_postchecks_v2(turns: DataFrame, subs_kept: int | None = MAX_SUBS, resolved_chars: int | None = RESOLVED_CHARS) -> DataFrame:
    """Corrections of the second router on (query_id, text, verdict JSON, has_file).

    Gives routing_decision, question_type, resolved_query, sub_questions and the trace label.
    """
    verdict = F.from_json(
        "verdict", "routing_decision string, question_type string, resolved_query string, sub_questions array<string>"
    )
    asked = tx.strip(F.coalesce("text", F.lit("")))
    df = turns.withColumn("_v", verdict).withColumn("_q", asked)
    given = F.coalesce(F.when(F.col("_v.routing_decision") != "", F.col("_v.routing_decision")), F.lit("single_retrieval"))
    kind = tx.strip(F.coalesce(F.when(F.col("_v.question_type") != "", F.col("_v.question_type")), F.lit("reasoning")))
    subs = F.filter(F.transform("_v.sub_questions", tx.strip), lambda s: s != "")
    df = df.withColumn("_subs", F.coalesce(subs if subs_kept is None else F.slice(subs, 1, subs_kept), F.array().cast("array<string>")))

    no_file = ~F.col("has_file") & ~tx.contains_any(F.col("_q"), FILE_WORDS)
    rest = F.regexp_replace(tx.replace_all(F.col("_q"), GUIDE_TRIGGERS, " "), "[^가-힣A-Za-z0-9]", "")
    not_meta = ~_mentions(F.col("_q"), SELF_REFERENCES) & (F.length(rest) > META_RESIDUAL)
    d = tx.strip(given)
    single = F.lit("single_retrieval")
    decision = (
        F.when(~d.isin(DECISIONS), single)
        .when((d == "file_chat") & no_file, single)
        .when((d == "ai_guide") & not_meta, single)
        .when((d == "multi_hop_retrieval") & (F.size("_subs") == 0), single)
        .otherwise(d)
    )
    resolved = tx.strip(F.coalesce("_v.resolved_query", F.lit("")))
    resolved = F.when((resolved == F.col("_q")) | (F.lit(False) if resolved_chars is None else F.length(resolved) > resolved_chars), F.lit("")).otherwise(resolved)
    kind = F.when(kind.isin(QUESTION_TYPES), kind).otherwise(F.lit("reasoning"))
    empty = F.col("_q") == ""
    label = F.concat(F.lit("router:"), decision, F.lit("/"), kind, F.when(resolved != "", F.lit("+resolved")).otherwise(F.lit("")))
    return df.select(
        "query_id",
        F.when(empty, "no_retrieval").otherwise(decision).alias("routing_decision"),
        F.when(empty, "reasoning").otherwise(kind).alias("question_type"),
        F.when(empty, "").otherwise(resolved).alias("resolved_query"),
        F.when(empty, F.array().cast("array<string>")).otherwise(F.col("_subs")).alias("sub_questions"),
        F.when(empty, "router:empty_input").otherwise(label).alias("label"),
    )


def accept_fallback(task: Column, confidence: Column, min_confidence: float = FALLBACK_MIN) -> Column:
    """Second opinion on a class: kept if allowed and sure enough, else unknown."""
    named = F.lower(tx.strip(F.coalesce(task, F.lit(""))))
    sure = F.coalesce(confidence, F.lit(0.0)) >= min_confidence
    return F.when(named.isin(TASKS) & sure, named).otherwise(F.lit("unknown"))
