"""Rules that the SQL twins cannot see, with values worked out by hand, and the constants that twins share with the library."""

import math

import pytest
from pyspark.sql import functions as F

from loomstone.operators import answers as an
from loomstone.operators import chunking as ck
from loomstone.operators import classify as cl
from loomstone.operators import evaluation as ev
from loomstone.operators import fusion as fu
from loomstone.operators import ingest as ing
from loomstone.operators import inventory as inv
from loomstone.operators import lexical as lx
from loomstone.operators import sections as se
from loomstone.operators import tagging as tg
from loomstone.plans.spread import spread
from loomstone.session import fresh_path, source_files, staged
from loomstone.sources import files as fi
from loomstone.sources import records as re_


def one(spark, column, **values):
    """Value of a column expression over one row of strings."""
    names = list(values) or ["_"]
    return spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()["v"]


def test_title_case_goes_past_marks(spark):
    for text, want in {"slide_subchunk": "Slide_Subchunk", "PAGE": "Page", "a1b c-d": "A1B C-D", "표 one": "표 One"}.items():
        assert one(spark, fu.title_case(F.col("t")), t=text) == want == text.title()


def test_digits_of_any_script_make_headings(spark):
    for line in ("1. 개요", "１. 개요", "٣. x"):
        assert one(spark, se.section_marker(F.col("t")), t=line)["kind"] == "num"
    assert one(spark, se.section_marker(F.col("t")), t="x. 개요") is None


def test_entries_of_one_id_leave_one_row(spark):
    names = "id string, question string, answer string, doc_id string, snippet string, location string, answer_type string"
    table = spark.createDataFrame([("a", "old", "old", "", "", "", "x"), ("b", "q", "a", "", "", "", "x")], names)
    new = spark.createDataFrame([("a", "q1", "a1", None, "s" * 600, None, None), (" a ", "q2", "a2", None, None, None, None)], names)
    got = ing.upsert_by_id(table, new).collect()
    assert sorted((r["id"], r["question"]) for r in got) == [("a", "q2"), ("b", "q")]
    assert tuple(ing.upsert_counts(table, new.unionByName(new.limit(0))).first()) == (2, 1, 1, 0, 1)
    assert tuple(ing.upsert_counts(table, new.limit(0)).first()) == (0, 0, 0, 0, 0)
    whole = ing.valid_entries(new, snippet_chars=None).collect()
    assert max(len(r["snippet"]) for r in whole) == 600


def test_seeds_win_and_keep_their_time(spark):
    names = "task string, text string, source string, created_at long"
    table = spark.createDataFrame([("t", "x", "admin", 1), ("t", "y", "admin", 2), ("t", "old", "seed", 3), ("t", "n", None, 4)], names)
    seeds = spark.createDataFrame([("t", "x", 9), ("t", "new", 8), ("t", "new", 7)], "task string, text string, created_at long")
    got = sorted(map(tuple, ing.reset_by_source(table, seeds).collect()), key=str)
    assert got == sorted([("t", "x", "seed", 9), ("t", "new", "seed", 8), ("t", "y", "admin", 2), ("t", "n", None, 4)], key=str)


def test_limits_of_logs_verdicts_and_topics_can_be_lifted(spark):
    row = spark.createDataFrame([(1, "u", "x" * 3000, "t", "{}")], "log_id long, user_id string, input_text string, final_task string, routing_debug string")
    row = row.withColumn("ts", F.timestamp_seconds(F.lit(0)))
    for chars, n in ((2000, 2000), (None, 3000)):
        assert len(re_.routing_log_rows(row, chars).first()["input_text"]) == n
    raw = '{"correct": true, "score_value": 0.5, "reasoning": "' + "r" * 900 + '" broken'
    for chars, n in ((500, 500), (None, 900)):
        got = one(spark, an.tolerant_json(F.col("t"), chars), t=raw)
        assert (len(got["reasoning"]), got["correct"]) == (n, True)
    assert one(spark, tg.normalize_topic(F.col("t")), t="y" * 60) == "general"
    assert one(spark, tg.normalize_topic(F.col("t"), None), t="y" * 60) == "y" * 60


def test_limits_can_be_lifted(spark):
    words = [f"word{i:02d}" for i in range(60)]
    capped, free = (one(spark, tg.extract_entities(F.col("t"), words, *limits), t=" ".join(words)) for limits in ((), (None, None)))
    assert len(capped) == 30 and set(free) >= set(words)
    answer = "수 " + " ".join(f"{i}개" for i in range(100, 130))
    assert len(one(spark, an.unsupported_numbers(F.col("a"), F.lit("")), a=answer)) == 5
    assert len(one(spark, an.unsupported_numbers(F.col("a"), F.lit(""), None), a=answer)) == 30
    items = "\n".join(f"- item number {i} of many" for i in range(40))
    assert len(one(spark, an.list_consistency(F.lit("q"), F.col("a"), F.lit("")), a=items)) == 5
    assert len(one(spark, an.list_consistency(F.lit("q"), F.col("a"), F.lit(""), None, None, None), a=items)) == 40
    raw = '{"summary": "' + "s" * 900 + '", "key_terms": [' + ", ".join(f'"k{i}"' for i in range(20)) + "]}"
    short, whole = (one(spark, tg.parse_doc_summary(F.col("r"), *limits), r=raw) for limits in ((), (None, None)))
    assert (len(short["summary"]), len(short["key_terms"]), len(whole["summary"]), len(whole["key_terms"])) == (300, 10, 900, 20)


def test_version_marks_come_off_until_none_is_left(spark):
    cases = {"Report_v2.docx": "report", "보고서_최종_수정본 (1).hwp": "보고서", "a copy copy backup.pdf": "a", "plan_v1.2_20240101.xlsx": "plan20240101", "x": "x", "No Marks.txt": "nomarks", ".hidden": ".hidden"}
    for name, want in cases.items():
        assert one(spark, inv.normalize_name(F.col("n")), n=name) == want, name


def test_sign_test_is_exact_and_bounded():
    def plain(wins, losses):
        n, k = wins + losses, min(wins, losses)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0

    for wins in range(0, 40, 3):
        for losses in range(0, 60, 7):
            assert math.isclose(ev._sign_test(wins, losses), plain(wins, losses), rel_tol=1e-9), (wins, losses)
    assert math.isclose(ev._sign_test(700, 600), plain(700, 600), rel_tol=1e-8)
    assert 0 < ev._sign_test(5_000_000, 5_001_000) < 1


def test_score_record_is_whole(spark):
    results = spark.createDataFrame(
        [(1, "x", None, True, 0.5, "why", ["m"], ["e"]), (2, "x", "boom", True, 1.0, "why", ["m"], []), (3, "gold here", None, None, None, None, None, None), (4, "x", None, True, 1.0, "r", [], []), (5, "x", None, None, None, None, None, None)],
        "id int, answer string, error string, judge_correct boolean, judge_score double, judge_reasoning string, judge_missing array<string>, judge_extra array<string>")
    labels = spark.createDataFrame([(1, "g", None, "reasoning"), (2, "g", None, "reasoning"), (3, "Gold", None, "numerical"), (4, "UNKNOWN", None, "reasoning"), (5, "g", None, "reasoning")], "id int, gold string, alternatives array<string>, answer_type string")
    got = {r["id"]: r for r in ev.score_answers(results, labels).collect()}
    assert [(got[i]["method"], got[i]["reasoning"]) for i in range(1, 6)] == [
        ("llm_judge", "why"), ("system_error", "시스템 오류: boom"), ("exact", "exact match (or alternative)"), ("skip_no_label", "라벨이 UNKNOWN/ERROR로 채점 불가"), ("judge_error", "")]
    assert (got[1]["missing"], got[1]["extra"], got[1]["ground_truth"]) == (["m"], ["e"], "g") and got[2]["missing"] == []


def test_lenient_verdicts_keep_missing_and_extra(spark):
    raw = 'ok: {"correct": true, "score_value": 0.5, "reasoning": "r", "missing": ["a"], "extra": ["b", "c"]} done'
    v = one(spark, an.tolerant_json(F.col("r")), r=raw)
    assert (v["correct"], v["missing"], v["extra"], v["stage"]) == (True, ["a"], ["b", "c"], "braces")
    assert one(spark, an.tolerant_json(F.col("r")), r="nothing")["missing"] == []


def test_staged_tables_follow_their_sources(spark):
    path = fresh_path(spark, "source")
    build = lambda: spark.read.parquet(path)
    spark.range(3).write.parquet(path)
    assert staged(spark, "kept", [path], build).count() == 3 == staged(spark, "kept", [path], build).count()
    spark.range(4).write.mode("append").parquet(path)
    assert staged(spark, "kept", [path], build).count() == 7


def test_only_small_tables_are_dealt_out(spark):
    path = fresh_path(spark, "small")
    spark.range(1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert spread(df, path).rdd.getNumPartitions() > 1 and spread(df, path, at_most=10) is df


def test_scan_says_what_it_cannot_see(spark, tmp_path):
    for name in ("a.txt", "_notes.txt", ".hidden.txt", "sub/b.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(r["path"] for r in fi.scan_corpus(spark, str(tmp_path)).collect()) == ["a.txt", "sub/b.md"]
    assert [p.rsplit("/", 1)[-1] for p in fi.underscored(spark, str(tmp_path))] == ["_notes.txt"]
    assert source_files(spark, str(tmp_path / "absent")) == []


@pytest.mark.parametrize(("name", "value", "want"), [
    ("bm25", (lx.K1, lx.B, lx.EPSILON), (1.5, 0.75, 0.25)),
    ("fusion", (fu.RRF_K, fu.RRF_K_V1, fu.RELEVANT, fu.PARTIAL), (3, 60, 0.5, 0.3)),
    ("routing", (cl.TOP1_MIN, cl.MARGIN_MIN, cl.BYPASS_MIN, cl.HINT_MIN, cl.FALLBACK_MIN), (0.62, 0.08, 0.92, 0.78, 0.7)),
    ("screen", (cl.SINGLE_MIN, cl.WINDOW_MIN, cl.RELEVANCE_MIN), (0.80, 0.76, 0.40)),
    ("bins", ev.BINS, [0.0, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.01]),
    ("sweep", ev.SWEEP[:2], [(0.50, 0.30), (0.55, 0.30)]),
    ("suffixes", fi.SUFFIXES, [".txt", ".md", ".pdf", ".docx", ".xlsx", ".xlsm", ".pptx"]),
    ("sections", (se.TITLE_CHARS, se.NUMBER_TITLE_CHARS, se.DOC_TITLE_CHARS), (120, 50, 60)),
    ("answers", (an.MAX_ISSUES, an.STRONG_SCORE, an.SHORT_ANSWER, an.CHECKED_ITEMS), (5, 0.7, 200, 15)),
])
def test_fixed_values(name, value, want):
    assert value == want, name


def test_size_thresholds_exist_for_every_format():
    assert {name for name, *_ in ck.SIZE_THRESHOLDS} >= {"pdf", "pptx", "docx", "xlsx", "txt", "md"}


def test_phrases_of_any_length_find_their_texts(spark):
    from loomstone.sources.records import holders

    texts = spark.createDataFrame([(1, "say one two now"), (2, "one  two"), (3, None), (4, "xtwo")], "item_id long, text string")
    phrases = spark.createDataFrame([(10, "one two"), (11, "two"), (12, "absent"), (13, None)], "query_id long, text string")
    for block in (1024, 1):
        assert sorted(map(tuple, holders(phrases, texts, block).collect())) == [(10, 1), (11, 1), (11, 2), (11, 4)]


def test_hybrid_search_by_hand(spark):
    from loomstone.operators import hybrid as hy

    chunks = spark.createDataFrame([(1, "red fox"), (2, "blue dog"), (3, "green bird sings"), (4, "red fox")], "chunk_id long, content string")
    index = lx.forward_index(chunks).cache()
    terms, _, avgdl = lx.bm25_index(index)
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [9.0, 9.0])], "item_id long, vector array<double>")
    facts = hy.item_facts(chunks, "chunk_id", "content")
    asked = spark.createDataFrame([(7, "blue bird", [0.0, 0.1]), (8, "green", None)], "query_id long, text string, vector array<double>")
    got = sorted((r["query_id"], r["place"], r["item_id"], r["dense_rank"], r["lexical_rank"]) for r in hy.hybrid_search(asked, index, terms, avgdl, vectors, facts, k=2, fetch=2).collect())
    # question 7: item 2 stands in both lists (dense 2, lexical 1); item 1 is nearest but without a word of it
    assert {r[2] for r in got if r[0] == 7} == {1, 2} and (8, 1, 3, None, 1) in got
    assert [r for r in got if r[2] == 2][0][3:] == (2, 1)


def test_digits_of_any_script(spark):
    from loomstone.operators import answers as an

    df = spark.createDataFrame([("３가지 알려줘", "[１] and [2], [１２]"), ("4개", "[1]"), ("세 가지", ""), ("١٢ 개", "[٣]")], "q string, a string")
    got = [(r[0], list(r[1])) for r in df.select(an.expected_count(df["q"]), an.cited_ids(df["a"])).collect()]
    assert got == [(3, [1, 2, 12]), (4, [1]), (3, []), (12, [3])]
