"""Reports of scored runs as Markdown, JSON lines and CSV.

Lines of a report are rows of (part, key, place, line): parts follow each other,
inside a part the keys, inside a key the places. A report holds figures and at
most ``n`` cases, so one task orders and writes it; scored rows are written as
they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators import evaluation as ev
from loomstone.sources.records import write_csv, write_eval_json

# Headings and labels of the reports, and lengths of answers and questions shown in them.
TABLES = [
    ("category", "## 카테고리별 정확도", "Category"),
    ("answer_type", "## Answer Type별 정확도", "Answer Type"),
    ("task_type", "## Task Type (라우팅) 별 정확도", "Task Type"),
]
ANSWER_CHARS, QUESTION_CHARS = 300, 80


def _one_line(col: str, chars: int | None = None) -> Column:
    text = F.translate(F.coalesce(F.col(col).cast("string"), F.lit("")), "\r\n", "  ")
    return text if chars is None else F.left(text, F.lit(chars))


def _lines(rows: DataFrame, part: int, key: Column, *lines: Column) -> DataFrame:
    """Each row as several lines in turn; null lines are left out."""
    of = rows.select(F.lit(part).alias("part"), key.alias("key"), F.posexplode(F.array(*lines)).alias("place", "line"))
    return of.where("line IS NOT NULL")


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _number(col: Column) -> Column:
    return col.cast("string")


def _share(part: Column, whole: Column) -> Column:
    return F.format_number(F.when(whole > 0, part / whole * 100).otherwise(0.0), 1)


def report_lines(scored: DataFrame, name: str, n: int = ev.LIST_ROWS) -> DataFrame:
    """A report of one run: overall figures, mean scores by three dimensions, the ``n`` worst answers.

    ``scored`` has id, category, answer_type, task_type, correct, score_value,
    error, method, elapsed_sec, question, ground_truth, answer, reasoning; line
    breaks in texts become blanks, null texts are empty. A run without rows has
    zeros.
    """
    none = F.lit("")
    total, correct = F.col("total"), F.col("correct")
    out = _lines(
        ev.accuracy_summary(scored), 0, none, F.lit(f"# Eval Report — `{name}`"), none,
        _said("- 총 문항: **", _number(total), "**"),
        _said("- 정답 (binary): **", _number(correct), "/", _number(total), " = ", _share(correct, total), "%**"),
        _said("- 평균 점수 (partial): **", F.format_number(F.coalesce("mean_score", F.lit(0.0)), 3), "**"),
        _said("- 시스템 오류: ", _number(F.col("errors"))), none,
    )
    one = scored.sparkSession.range(1)
    by = ev.breakdown(scored)
    for part, (dimension, heading, label) in enumerate(TABLES, 1):
        head = _lines(one, 3 * part, none, F.lit(heading), F.lit(f"| {label} | N | Avg Score |"), F.lit("| --- | --- | --- |"))
        line = _said("| ", F.translate("value", "\r\n", "  "), " | ", _number(F.col("n")), " | ", F.format_number(F.col("mean_score") * 100, 1), "% |")
        rows = _lines(by.where(F.col("dimension") == dimension), 3 * part + 1, F.col("value"), line)
        out = out.unionByName(head).unionByName(rows).unionByName(_lines(one, 3 * part + 2, none, none))
    worst = ev.top_failures(scored, n)
    head = _lines(worst.agg(F.count("*").alias("n")), 20, none, _said("## 상위 실패 사례 (", _number(F.col("n")), "건)"))
    key = _said(F.format_string("%018.9f", F.col("score_value")), F.format_string("%020d", F.col("id").cast("long")))
    cases = _lines(
        worst, 21, key, _said("### Q", _number(F.col("id")), " [", _one_line("category"), "]"), _said("- **질문**: ", _one_line("question")),
        _said("- **정답**: ", _one_line("ground_truth")), _said("- **시스템 답변**: ", _one_line("answer", ANSWER_CHARS)),
        _said("- **task_type**: `", _one_line("task_type"), "`"),
        _said("- **judge**: score=", F.format_number("score_value", 2), ", method=", _one_line("method")), _said("  - reasoning: ", _one_line("reasoning")), none,
    )
    return out.unionByName(head).unionByName(cases)


def comparison_lines(base: DataFrame, other: DataFrame, base_name: str, other_name: str, n: int = ev.LIST_ROWS) -> DataFrame:
    """A report of two runs over their common questions: totals, change, and ``n`` cases gained and lost, by id."""
    compared = ev.compare_runs(base, other)
    none, common = F.lit(""), F.col("common")

    def side(name: str, right: str) -> Column:
        return _said(f"- {name}: ", _number(F.col(right)), "/", _number(common), " = ", _share(F.col(right), common), "%")

    sums = ev.compare_summary(compared)
    out = _lines(
        sums, 0, none, F.lit(f"# Compare — `{base_name}` vs `{other_name}`"), none, _said("- 공통 문항: ", _number(common)),
        side(base_name, "base_correct"), side(other_name, "other_correct"),
        _said("- **변화: ", F.format_string("%+d", F.col("delta").cast("long")), "**"), none,
    )
    for part, change, label in ((1, "improved", "## 신규 정답 (개선 "), (2, "regressed", "## 신규 오답 (회귀 ")):
        head = _lines(sums, 2 * part, none, _said(label, _number(F.col(change)), "건)"))
        first = compared.where(F.col("change") == change).select("id").orderBy("id").limit(n)
        told = first.join(base.select("id", "category", "question"), "id")
        line = _said("- Q", _number(F.col("id")), " [", _one_line("category"), "]: ", _one_line("question", QUESTION_CHARS))
        out = out.unionByName(head).unionByName(_lines(told, 2 * part + 1, F.format_string("%020d", F.col("id").cast("long")), line))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in their order as one text file."""
    lines.orderBy("part", "key", "place").coalesce(1).select("line").write.mode("overwrite").text(path)


def write_reports(scored: DataFrame, path: str, name: str, n: int = ev.LIST_ROWS) -> None:
    """``report`` (Markdown), ``scored`` (JSON lines) and ``breakdown`` (CSV with mark) under one folder."""
    write_lines(report_lines(scored, name, n), f"{path}/report")
    write_eval_json(scored, f"{path}/scored")
    write_csv(ev.breakdown(scored), f"{path}/breakdown")
