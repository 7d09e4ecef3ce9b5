"""Reports read back from their files, flat texts and chunk metadata."""

from pyspark.sql import functions as F

from loomstone.operators import sections as se
from loomstone.operators import tagging as tg
from loomstone.sources import reports as rp

RUN = "id long, category string, answer_type string, task_type string, correct boolean, score_value double, error string, method string, elapsed_sec double, question string, ground_truth string, answer string, reasoning string"


def run(spark, rows):
    return spark.createDataFrame(rows, RUN)


def lines(path):
    return [line for f in sorted(path.glob("part-*.txt")) for line in f.read_text().split("\n")[:-1]]


def test_reports_in_three_formats(spark, tmp_path):
    rows = [
        (1, "A", "numerical", "search", True, 1.0, None, "match", 2.0, "q1", "g1", "a1", "r1"),
        (2, "B", None, "", False, 0.5, None, "llm_judge", 1.0, "two\nlines", "g2", "x" * 400, None),
        (10, "A", "numerical", "search", False, 0.0, "timeout", "system_error", 3.0, "q10", "g10", None, "r10"),
        (9, "A", "numerical", "search", False, 0.5, None, "match", 3.0, "q9", "g9", "a9", "r9"),
    ]
    rp.write_reports(run(spark, rows), str(tmp_path), "first", n=2)
    text = lines(tmp_path / "report")
    assert text[:7] == ["# Eval Report — `first`", "", "- 총 문항: **4**", "- 정답 (binary): **1/4 = 25.0%**", "- 평균 점수 (partial): **0.500**", "- 시스템 오류: 1", ""]
    assert text[7:13] == ["## 카테고리별 정확도", "| Category | N | Avg Score |", "| --- | --- | --- |", "| A | 3 | 50.0% |", "| B | 1 | 50.0% |", ""]
    at = text.index("## 상위 실패 사례 (2건)")
    assert [t for t in text[at:] if t.startswith("###")] == ["### Q10 [A]", "### Q2 [B]"]
    assert "- **질문**: two lines" in text and "- **시스템 답변**: " + "x" * 300 in text and text[-1] == ""
    assert spark.read.json(str(tmp_path / "scored")).count() == 4
    assert next((tmp_path / "breakdown").glob("part-*.csv")).read_bytes().startswith("﻿".encode())
    empty = run(spark, [])
    rp.write_lines(rp.report_lines(empty, "none"), str(tmp_path / "none"))
    assert "- 정답 (binary): **0/0 = 0.0%**" in lines(tmp_path / "none")


def test_comparison(spark, tmp_path):
    def one(i, right):
        return (i, "A", None, "", right, float(right), None, "m", 1.0, f"q{i}", "g", "a", "r")

    base = run(spark, [one(i, i % 2 == 0) for i in range(1, 31)])
    other = run(spark, [one(i, i != 4) for i in range(2, 40)])
    rp.write_lines(rp.comparison_lines(base, other, "x", "y", n=3), str(tmp_path / "c"))
    text = lines(tmp_path / "c")
    assert text[2:6] == ["- 공통 문항: 29", "- x: 15/29 = 51.7%", "- y: 28/29 = 96.6%", "- **변화: +13**"]
    assert text[7:] == ["## 신규 정답 (개선 14건)", "- Q3 [A]: q3", "- Q5 [A]: q5", "- Q7 [A]: q7", "## 신규 오답 (회귀 1건)", "- Q4 [A]: q4"]


def test_flat_texts_cut_by_length(spark):
    rows = [(1, 2, "two", i, [f"r{i}", "v" * i]) for i in range(1, 40)] + [(1, 1, "one", 5, ["a|b", None]), (1, 1, "one", 9, ["c", "d", "e"]), (1, 3, "gone", 1, [" ", None]), (2, 1, "only", 0, ["x"])]
    sheets = spark.createDataFrame(rows, "doc_id long, sheet_no int, sheet string, row_no int, cells array<string>").repartition(4)
    one = "## 시트: one\n\n| a\\|b |  |  |\n|---|---|---|\n| c | d | e |"
    two = "## 시트: two\n\n| r1 | v |\n|---|---|\n" + "\n".join(f"| r{i} | {'v' * i} |" for i in range(2, 40))
    whole = {1: f"{one}\n\n{two}", 2: "## 시트: only\n\n| x |\n|---|"}
    for chars in (8000, 120, len(one) + 1, 3):
        got = {r["doc_id"]: (r["full_chars"], r["context"]) for r in se.flat_sheet_text(sheets, chars).collect()}
        assert got == {d: (len(t), t[:chars]) for d, t in whole.items()}
    items = [(1, 0, " first ", None), (1, 1, None, [["h"], ["1"]]), (1, 2, "", None), (1, 3, None, [[" "]]), (1, 4, "last", None), (1, 5, None, [["k", "l"]])]
    files = spark.createDataFrame(items, "doc_id long, pos long, text string, rows array<array<string>>")
    text = "first\n\nlast\n\n## 표 1\n\n| h |\n|---|\n| 1 |\n\n## 표 3\n\n| k | l |\n|---|---|"
    row = se.flat_paragraph_text(files).first()
    assert (row["full_chars"], row["context"]) == (len(text), text)


def test_flat_sheet_lines_travel_drawn(spark):
    rows = [(1, 7, None, i, ["x" * (i % 3), str(i)] + ["w"] * (i == 9000)) for i in range(1, 9001)] + [(1, 3, "b", 1, ["y" * 50]), (1, 3, "a", 2, ["z", "z"]), (None, 1, "no", 1, ["q"]), (2, None, "no", 1, ["q"])]
    df = spark.createDataFrame(rows, "doc_id long, sheet_no int, sheet string, row_no int, cells array<string>").repartition(5)
    first = "## 시트: a\n\n| " + "y" * 50 + " |  |\n|---|---|\n| z | z |"
    lines = [f"| {'x' * (i % 3)} | {i} | {'w' if i == 9000 else ''} |" for i in range(1, 9001)]
    text = first + "\n\n" + "\n".join([lines[0], "|---|---|---|", *lines[1:]])  # a sheet without a name has no title
    for chars in (10, 8000, len(text) - 5):
        out = se.flat_sheet_text(df, chars)
        assert [tuple(r) for r in out.collect()] == [(1, len(text), text[:chars])]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()  # titles are no rows of their own


def test_chunk_metadata(spark):
    made = "doc_id long, unit_index int, unit_type string, title string, section_path string, text string, is_table boolean, table_index int, parent_page_index int, split_part string, merged_units array<int>, doc_format string"
    rows = [(1, 3, "page", "", "p", "see 12:30", False, 7, None, "1/2", [3, 4], ".pdf"), (2, 9, "table", "T", None, "x", True, 1, 2, None, [], None)]
    tagged = tg.chunk_metadata(tg.tag_chunks(spark.createDataFrame(rows, made)))
    got = {r["doc_id"]: r["metadata"] for r in tagged.collect()}
    assert got[1] == {
        "doc_id": "1", "doc_format": ".pdf", "page_unit_index": "3", "page_unit_type": "page", "page_unit_title": "", "section_path": "p", "is_table": "false",
        "char_count": "9", "merged_units": "3, 4", "split_part": "1/2", "entities": "12:30", "doc_topic": "general", "doc_summary": "", "key_terms": "",
        "title": "1", "display_source": "1", "source": "file",
    }
    assert (got[2]["table_index"], got[2]["parent_page_index"], got[2]["title"]) == ("1", "2", "T")
    assert not {"doc_format", "section_path", "merged_units", "split_part"} & got[2].keys()
    assert tagged.select(F.size("metadata")).count() == 2


def test_heading_sections_move_texts_once(spark):
    grid = [["a", None], [" ", ""], ["b", "c"]]
    items = [
        (1, 0, 0, "start", None), (1, 1, 0, None, [[" "]]), (1, 2, 1, " One ", None), (1, 3, 2, "Sub", None), (1, 4, 0, None, grid), (1, 5, 3, "deep", None), (1, 5000, 0, "far", None),
        (1, 5001, 1, "Two", None), (1, 5002, 0, "text beside", grid), (1, 5003, None, "no level", None), (1, 5004, 2, "", None), (1, 5005, 0, "end", None), (2, 0, 2, "Only", None),
    ]
    out = se.heading_sections(spark.createDataFrame(items, "doc_id long, pos long, level int, text string, rows array<array<string>>").repartition(4))
    drawn = "| a |  |\n|---|---|\n| b | c |"
    got = sorted(tuple(r) for r in out.select("unit_index", "title", "section_path", "text", "is_table", "table_index", "parent_page_index").collect())
    assert got == [
        (1, "섹션 1", "", "# 섹션 1\n\nstart", False, None, None), (2, "Sub", "One / Sub", "# Sub\n\n### deep\n\nfar", False, None, None), (3, "Two", "Two", "# Two\n\nend", False, None, None),
        (10001, "Sub — 표 1", "One / Sub", drawn, True, 1, 2), (10002, "Two — 표 2", "Two", drawn, True, 2, 3),
    ]
    plan = out._jdf.queryExecution().executedPlan().toString()  # sections are not made anew for each kind of unit
    assert "Union" not in plan and plan.count("Exchange hashpartitioning") <= 14
