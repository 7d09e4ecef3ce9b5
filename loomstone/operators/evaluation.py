"""Scoring of answers and analysis of scored runs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.ordered import top_rows

# Punctuation dropped from answers, kinds scored by match, bins, sweeps, the trace pattern.
PUNCTUATION = "[\\[\\]\\(\\)\\{\\}『』「」'\"·,.;:!?]"
MATCHED_TYPES = ["numerical", "fill_blank", "exact_phrase"]
NO_LABEL = ["UNKNOWN", "ERROR", ""]
BINS = [0.0, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.01]
SWEEP = [(0.50, 0.30), (0.55, 0.30), (0.55, 0.35), (0.60, 0.35), (0.60, 0.40), (0.65, 0.40), (0.70, 0.45)]
SETTINGS = [("baseline", 0.50, 0.30), ("medium", 0.55, 0.35), ("strict", 0.60, 0.40)]
COVERAGES = ["full", "partial", "none"]
WEAK_BELOW, LIST_ROWS, REVIEW_BELOW = 0.6, 20, 0.7
UNGRADED = "라벨 UNKNOWN — 분모 제외"
GRADE = (
    r"grade:(pass|all_irrelevant|exhausted_after_[0-9]+rewrites|no_docs)"
    r"(?:\(([0-9]+)rel/(?:([0-9]+)kept/)?([0-9]+)total,max=([0-9.]+),cov=(full|partial|none)\))?"
)

SAID_CORRECT = r"""^\{(?:.*,)?\s*(?:'correct'|"correct")\s*:\s*(?:True|true|1)\s*[,}]"""


def normalize_answer(text: Column) -> Column:
    """Lower case, white space squeezed to single blanks, punctuation dropped."""
    squeezed = F.lower(tx.strip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{tx.WS}+", " ")))
    return F.regexp_replace(squeezed, PUNCTUATION, "")


def exact_or_alt(answer: Column, gold: Column, alternatives: Column) -> Column:
    """True if the gold answer or an alternative stands in the answer, all normalized."""
    wanted = F.transform(F.concat(F.array(gold), F.coalesce(alternatives, F.array().cast("array<string>"))), normalize_answer)
    return tx.let(normalize_answer(answer), lambda a: F.exists(wanted, lambda c: (c != "") & F.contains(a, c)))


def score_answers(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Score (id, answer, error, judge_correct, judge_score) against (id, gold, alternatives, answer_type).

    Adds ``correct``, ``score_value``, ``method``, ``reasoning``, ``missing``,
    ``extra`` and ``ground_truth``; the judge's columns (judge_reasoning,
    judge_missing and judge_extra may be left out) count only where no earlier
    rule decides, and a missing judge is an error.
    """
    known = labels.select("id", "gold", "alternatives", "answer_type", F.lit(True).alias("_label"))
    out = results.join(known, "id", "left")
    kind = F.coalesce("answer_type", F.lit("reasoning"))
    matched = kind.isin(MATCHED_TYPES) & exact_or_alt(F.col("answer"), F.col("gold"), F.col("alternatives"))
    method = (
        F.when(F.col("_label").isNull(), "no_label")
        .when(F.coalesce("error", F.lit("")) != "", "system_error")
        .when(F.coalesce("gold", F.lit("")).isin(NO_LABEL), "skip_no_label")
        .when(matched, "exact")
        .when(F.col("judge_correct").isNull() & F.col("judge_score").isNull(), "judge_error")
        .otherwise("llm_judge")
    )
    out = out.withColumn("method", method)
    judged = F.col("method") == "llm_judge"
    exact = F.col("method") == "exact"
    out = out.withColumn("correct", exact | (judged & F.coalesce("judge_correct", F.lit(False))))
    score = F.when(exact, 1.0).when(judged, F.coalesce("judge_score", F.lit(0.0))).otherwise(0.0)
    none = F.array().cast("array<string>")

    def given(column: str, absent: Column) -> Column:
        return F.when(judged, F.coalesce(F.col(column), absent)).otherwise(absent) if column in results.columns else absent

    m = F.col("method")
    reason = (
        F.when(m == "system_error", F.concat(F.lit("시스템 오류: "), "error"))
        .when(m == "skip_no_label", "라벨이 UNKNOWN/ERROR로 채점 불가")
        .when(m == "exact", "exact match (or alternative)")
        .otherwise(given("judge_reasoning", F.lit("")))
    )
    out = out.withColumn("score_value", score).withColumn("reasoning", reason).withColumn("ground_truth", F.col("gold"))
    return out.withColumn("missing", given("judge_missing", none)).withColumn("extra", given("judge_extra", none)).drop("_label")


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """One row: total, correct, accuracy, mean score, errors, mean seconds."""
    failed = (F.coalesce("error", F.lit("")) != "") | (F.col("method") == "system_error")
    return scored.agg(
        F.count("*").alias("total"),
        F.count_if("correct").alias("correct"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
        F.round(F.avg("score_value"), 6).alias("mean_score"),
        F.count_if(failed).alias("errors"),
        F.round(F.avg("elapsed_sec"), 6).alias("mean_elapsed"),
    )


def breakdown(scored: DataFrame) -> DataFrame:
    """Mean score and number by category, by answer type and by task type, in one pass over the run."""
    dims = ["category", "answer_type", "task_type"]
    rows = scored.select(
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("answer_type", F.lit("reasoning")).alias("answer_type"),
        F.coalesce(F.when(F.col("task_type") != "", F.col("task_type")), F.lit("unknown")).alias("task_type"),
        "score_value",
    )
    cube = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.grouping_id(*dims).alias("g"), F.avg("score_value").alias("mean_score"), F.count("*").alias("n")
    )
    dimension = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "answer_type").otherwise("task_type")
    return cube.select(dimension.alias("dimension"), F.coalesce(*dims).alias("value"), F.round("mean_score", 6).alias("mean_score"), "n")


def top_failures(scored: DataFrame, n: int = LIST_ROWS) -> DataFrame:
    return scored.filter(~F.col("correct")).orderBy("score_value", "id").limit(n)


def compare_runs(base: DataFrame, other: DataFrame) -> DataFrame:
    """Questions of both runs with the change between them: (id, base_correct, other_correct, change)."""
    both = base.select("id", F.col("correct").alias("base_correct")).join(other.select("id", F.col("correct").alias("other_correct")), "id")
    change = (
        F.when(~F.col("base_correct") & F.col("other_correct"), "improved")
        .when(F.col("base_correct") & ~F.col("other_correct"), "regressed")
        .otherwise("same")
    )
    return both.withColumn("change", change)


def compare_summary(compared: DataFrame) -> DataFrame:
    b, o = F.col("base_correct").cast("long"), F.col("other_correct").cast("long")
    return compared.agg(
        F.count("*").alias("common"), F.coalesce(F.sum(b), F.lit(0)).alias("base_correct"), F.coalesce(F.sum(o), F.lit(0)).alias("other_correct"),
        F.count_if(F.col("change") == "improved").alias("improved"), F.count_if(F.col("change") == "regressed").alias("regressed"),
        F.coalesce(F.sum(o - b), F.lit(0)).alias("delta"),
    )


def apply_overrides(scored: DataFrame, fixes: DataFrame, unknown: DataFrame) -> DataFrame:
    """Set (id, reason) of ``fixes`` to correct and mark the ids of ``unknown`` as ungraded."""
    out = scored.join(fixes.select("id", F.col("reason").alias("_fix")), "id", "left")
    out = out.join(unknown.select("id").distinct().withColumn("_unknown", F.lit(True)), "id", "left")
    turned = F.col("_fix").isNotNull() & ~F.col("correct")
    out = out.withColumn("relabeled", turned).withColumn("original_reasoning", F.when(turned, F.col("reasoning")))
    out = out.withColumn("relabel_reason", F.when(turned, F.col("_fix"))).withColumn("ungraded_reason", F.when(F.col("_unknown"), F.lit(UNGRADED)))
    out = out.withColumn("reasoning", F.when(F.col("relabeled"), F.concat(F.lit("[RELABELED] "), "_fix")).otherwise(F.col("reasoning")))
    out = out.withColumn("score_value", F.when(F.col("relabeled"), F.lit(1.0)).otherwise(F.col("score_value")))
    out = out.withColumn("correct", F.col("correct") | F.col("relabeled"))
    return out.withColumn("ungraded", F.coalesce("_unknown", F.lit(False))).drop("_fix", "_unknown")


def fix_labels(labels: DataFrame, fixes: DataFrame) -> DataFrame:
    """Labels (id, answer, answer_type, confidence, error) with the fixed rows' values; a fix clears the error."""
    f = fixes.select("id", *[F.col(c).alias(f"_{c}") for c in ("answer", "answer_type", "confidence")], F.lit(True).alias("_fixed"))
    out = labels.join(f, "id", "left")
    for c in ("answer", "answer_type", "confidence"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    out = out.withColumn("error", F.when(F.col("_fixed").isNull(), F.col("error")))
    return out.withColumn("fixed", F.coalesce("_fixed", F.lit(False))).drop("_answer", "_answer_type", "_confidence", "_fixed")


def accuracy_excluding(before: DataFrame, after: DataFrame) -> DataFrame:
    """Accuracy of a run before overrides, over all, and after them, ungraded questions left out."""
    was = before.agg(F.count("*").alias("total"), F.count_if("correct").alias("correct_before"))
    now = after.agg(
        F.count_if("relabeled").alias("relabeled"), F.count_if("ungraded").alias("ungraded"),
        F.count_if(~F.col("ungraded")).alias("graded"), F.count_if(F.col("correct") & ~F.col("ungraded")).alias("correct_after"),
    )
    one = was.withColumn("_k", F.lit(1)).join(now.withColumn("_k", F.lit(1)), "_k").drop("_k")
    b = F.col("correct_before") / F.col("total") * 100
    a = F.col("correct_after") / F.col("graded") * 100
    return one.select("*", F.round(b, 6).alias("accuracy_before"), F.round(a, 6).alias("accuracy_after"), F.round(a - b, 6).alias("gain"))


def parse_grade_log(runs: DataFrame, id_col: str, path_col: str) -> DataFrame:
    """First and last grade step of each trace: (id, n_grades, first_*, final_*)."""

    def grade(step: Column) -> dict[str, Column]:
        def group(n: int) -> Column:
            return F.regexp_extract(step, GRADE, n)

        def number(n: int) -> Column:
            return F.coalesce(group(n).try_cast("int"), F.lit(0))

        return {
            "status": group(1), "rel": number(2), "kept": number(3), "total": number(4),
            "max": F.coalesce(group(5).try_cast("double"), F.lit(0.0)),
            "cov": F.when(group(6) != "", group(6)).otherwise("none"),
        }

    # Steps are told apart first and only the two that count are read, each value by itself: what nobody asks for is not matched.
    steps = F.filter(F.col(path_col), lambda s: F.rlike(s, F.lit(GRADE)))
    out = runs.withColumn("_g", steps).filter(F.size("_g") > 0)
    # Spark may read these before the filter above, so they must bear an empty array.
    first, final = F.get("_g", F.lit(0)), F.get("_g", F.size("_g") - 1)
    parts = [v.alias(f"{n}_{c}") for n, p in (("first", first), ("final", final)) for c, v in grade(p).items()]
    return out.select(id_col, F.size("_g").alias("n_grades"), *parts)


def said_correct(score: Column) -> Column:
    """Whether a score kept as text says ``correct``: a JSON object or a printed dictionary; false where it says nothing."""
    text = tx.strip(F.coalesce(score, F.lit("")))
    return F.rlike(text, F.lit(SAID_CORRECT))


def graded_runs(grades: DataFrame, runs: DataFrame) -> DataFrame:
    """First grade of every trace beside what its answer scored: (id, score, coverage, correct).

    ``grades`` comes from ``parse_grade_log`` under ``id``, ``runs`` is (id,
    score) with the score as text. A trace without a score counts as wrong, a
    run without grades is left out.
    """
    judged = runs.select("id", said_correct(F.col("score").cast("string")).alias("correct"))
    out = grades.select("id", F.col("first_max").alias("score"), F.col("first_cov").alias("coverage")).join(judged, "id", "left")
    return out.withColumn("correct", F.coalesce("correct", F.lit(False)))


def score_histogram(rows: DataFrame, score: str = "score", bins: Sequence[float] = BINS) -> DataFrame:
    """Right and wrong per score bin; empty bins stay. The bin is found by comparison, not by a range join."""
    at = F.when(F.lit(False), F.lit(0))
    for i, (low, high) in enumerate(zip(bins, bins[1:])):
        at = at.when((F.col(score) >= low) & (F.col(score) < high), F.lit(i))
    counted = rows.withColumn("bin", at).filter("bin is not null").groupBy("bin").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct")
    )
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(bins, bins[1:]))], "bin int, low double, high double")
    out = table.join(counted, "bin", "left").fillna({"n": 0, "correct": 0})
    precision = F.when(F.col("n") > 0, F.col("correct") / F.col("n")).otherwise(0.0)
    return out.select("bin", "low", "high", "correct", (F.col("n") - F.col("correct")).alias("wrong"), F.round(precision, 6).alias("precision"))


def coverage_accuracy(rows: DataFrame) -> DataFrame:
    """Number, right ones and accuracy per coverage class; classes without rows stay."""
    counted = rows.groupBy("coverage").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))
    table = rows.sparkSession.createDataFrame([(c,) for c in COVERAGES], "coverage string")
    out = table.join(counted, "coverage", "left").fillna({"n": 0, "correct": 0})
    return out.withColumn("accuracy", F.round(F.when(F.col("n") > 0, F.col("correct") / F.col("n") * 100).otherwise(0.0), 6))


def threshold_sweep(rows: DataFrame, score: str = "score", pairs: Sequence[tuple[float, float]] = SWEEP) -> DataFrame:
    """Per threshold pair: passed, right among them, rejected, right ones lost; one pass over the rows for all pairs."""
    s = F.col(score)
    sums = []
    for i, (rel, par) in enumerate(pairs):
        sums += [
            F.count_if(s >= rel).alias(f"p{i}"), F.count_if((s >= rel) & F.col("correct")).alias(f"pc{i}"),
            F.count_if(s < par).alias(f"r{i}"), F.count_if((s < par) & F.col("correct")).alias(f"rc{i}"),
        ]
    one = rows.agg(*sums)
    lines = F.array(
        *[
            F.struct(
                F.lit(float(rel)).alias("relevant"), F.lit(float(par)).alias("partial"), F.col(f"p{i}").alias("passed"),
                F.round(F.when(F.col(f"p{i}") > 0, F.col(f"pc{i}") / F.col(f"p{i}") * 100).otherwise(0.0), 6).alias("pass_accuracy"),
                F.col(f"r{i}").alias("rejected"), F.col(f"rc{i}").alias("lost"),
            )
            for i, (rel, par) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(lines))


def weak_passes(rows: DataFrame, score: str = "score", below: float = WEAK_BELOW, n: int = LIST_ROWS) -> DataFrame:
    """Lowest scored wrong rows and lowest scored right rows under the limit, ``n`` of each."""
    weak = rows.filter((F.col(score) < below) & F.col("correct").isNotNull())
    lowest = top_rows(weak, ["correct"], [F.col(score), F.col("id")], n, "_place")  # one pass over the rows for both sides
    return lowest.withColumn("kind", F.when(F.col("correct"), "at_risk").otherwise("suspect")).drop("_place")


def ablation_matrix(runs: DataFrame, settings: Sequence[str], value: str) -> DataFrame:
    """One row per question, one column per setting."""
    return runs.groupBy("id").pivot("setting", list(settings)).agg(F.first(value))


def label_quality(labels: DataFrame) -> DataFrame:
    """One row: labels, those to review, failures."""
    review = F.coalesce("needs_review", F.coalesce("confidence", F.lit(0.0)) < REVIEW_BELOW)
    return labels.agg(
        F.count("*").alias("labels"), F.count_if(review).alias("to_review"), F.count_if(F.col("answer") == "ERROR").alias("failed"),
        F.count_if(F.col("answer") == "UNKNOWN").alias("unknown"),
    )


def first_gold(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Rank of the first gold item per question that has gold, null if none was hit: (query_id, gold_rank)."""
    found = hits.join(gold.select("query_id", "item_id").distinct(), ["query_id", "item_id"]).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return gold.select("query_id").distinct().join(found, "query_id", "left")


def recall_mrr(hits: DataFrame, gold: DataFrame, kinds: DataFrame, ks: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """Recall at several cuts and mean reciprocal rank, by question kind and over all (kind null)."""
    ranked = first_gold(hits, gold).join(kinds.select("query_id", "kind"), "query_id")
    r = F.col("gold_rank")
    return ranked.rollup("kind").agg(
        F.count("*").alias("questions"),
        *[F.round(F.avg(F.coalesce(r <= k, F.lit(False)).cast("double")), 6).alias(f"recall_{k}") for k in ks],
        F.round(F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0))), 6).alias("mrr"),
    )


def _sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial p of a split into wins and losses.

    The lower tail P(X <= k) of n fair draws is the regularized incomplete beta
    function at one half, I(n - k, k + 1), by its continued fraction: the work
    does not grow with the counts.
    """
    from math import exp, lgamma, log

    n, k = wins + losses, min(wins, losses)
    if wins == losses:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 0.5
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a + b) * log(x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d)
            c = 1.0 + term / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return min(1.0, 2.0 * front * value)


def paired_test(compared: DataFrame) -> DataFrame:
    """Discordant pairs of two settings and the exact p of their split."""

    @F.pandas_udf("double")
    def p_value(wins: pd.Series, losses: pd.Series) -> pd.Series:
        return pd.Series([_sign_test(int(w), int(l)) for w, l in zip(wins, losses)])

    one = compared.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("change") == "improved").alias("gained"), F.count_if(F.col("change") == "regressed").alias("lost")
    )
    return one.withColumn("p_value", F.round(p_value("gained", "lost"), 6))


def rrf_sweep(dense: DataFrame, lexical: DataFrame, gold: DataFrame, constants: Sequence[int], k: int) -> DataFrame:
    """Recall at ``k`` and reciprocal rank per fusion constant from one stored pair of rankings.

    Both lists are grouped once; the constants are applied to the ranks that
    met in a text.
    """
    from loomstone.plans.ordered import top_rows

    cols = ["query_id", "item_id", "text_key", "rank"]
    both = dense.select(*cols, F.lit(0).alias("side")).unionByName(lexical.select(*cols, F.lit(1).alias("side")))
    d, x = F.col("side") == 0, F.col("side") == 1
    sums = [F.sum(F.lit(1.0) / (F.lit(float(c)) + F.col("rank"))).alias(f"c{c}") for c in constants]
    met = both.groupBy("query_id", "text_key").agg(
        *sums, F.min(F.when(d, F.col("rank"))).alias("dense_rank"), F.min(F.when(x, F.col("rank"))).alias("lexical_rank")
    )
    spread = F.inline(F.array(*[F.struct(F.lit(c).alias("rrf_k"), F.col(f"c{c}").alias("rrf")) for c in constants]))
    rows = met.select("query_id", "text_key", "dense_rank", "lexical_rank", spread)
    order = [F.round("rrf", 9).desc(), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank")]
    cut = top_rows(rows, ["rrf_k", "query_id"], order, k)
    wanted = gold.select("query_id", "text_key").distinct()
    found = cut.join(wanted, ["query_id", "text_key"]).groupBy("rrf_k", "query_id").agg(F.min("rank").alias("gold_rank"))
    asked = gold.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.lit(c) for c in constants])).alias("rrf_k"))
    out = asked.join(found, ["rrf_k", "query_id"], "left").groupBy("rrf_k")
    r = F.col("gold_rank")
    return out.agg(
        F.count("*").alias("questions"), F.round(F.avg(r.isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / r, F.lit(0.0))), 6).alias("mrr"),
    )


def failure_source(scored: DataFrame, context: DataFrame, gold: DataFrame) -> DataFrame:
    """Wrong answers by cause: the gold item was not among the hits, or it was and the answer missed it."""
    seen = first_gold(context, gold).withColumnRenamed("query_id", "id")
    wrong = scored.filter(~F.col("correct")).join(seen, "id")
    cause = F.when(F.col("gold_rank").isNull(), "retrieval").otherwise("generation")
    counted = wrong.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    total = wrong.agg(F.count("*").alias("_total")).withColumn("_k", F.lit(1))
    return counted.withColumn("_k", F.lit(1)).join(total, "_k").select("cause", "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"))


def markdown_lines(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Rows of a Markdown table for a report: (place, line), header and rule first."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame(
        [(0, "", "| " + " | ".join(columns) + " |"), (1, "", "| " + " | ".join("---" for _ in columns) + " |")], "place int, key string, line string"
    )
    return head.unionByName(df.select(F.lit(2).alias("place"), F.col(order).cast("string").alias("key"), line.alias("line")))
