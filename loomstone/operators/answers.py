"""Text screens and checks of answers against the hits they rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx

# Screening rules (case does not count), messages, number and list patterns, limits.
INJECTION_RULES = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|rules?)",
    r"forget\s+(your|all)\s+(persona|instructions?|rules?)",
    r"이전\s*(지침|명령|규칙)\s*(을|를)?\s*무시",
    r"모든\s*(규칙|지침|명령)\s*(을|를)?\s*무시",
    r"(reveal|show|print|output|dump|expose|disclose|tell\s+me)\s+(me\s+)?(your|the)?\s*(system\s*prompt|system\s*instructions?|initial\s*instructions?|api\s*key|secret\s*key|credentials?)",
    r"(시스템\s*프롬프트|내부\s*지침|시스템\s*지침|프롬프트\s*내용)\s*(을|를|이|가)?\s*[^.\n]{0,20}?(출력|공개|보여|알려|보고|노출|말해|드러)",
    r"(DAN|do\s+anything\s+now)\s+mode",
    r"you\s+are\s+now\s+(DAN|a\s+different|an?\s+unrestricted)",
    r"(제약|제한)\s*(없는|없이)\s*AI\s*(로|처럼|인\s*척)",
    r"지금부터\s*너는\s*[^.\n]{0,20}(AI|봇|어시스턴트)",
    r"\[IGNORE\s*PREVIOUS\]",
    r"<<\s*SYS\s*>>",
    r"system\s*override\s*[:：]",
    r"(api[\s_]?key|access[\s_]?key|secret[\s_]?key)\s*[=:]\s*\S{10,}",
]
BLOCK_MESSAGE = "[보안 정책에 의해 해당 내용이 차단되었습니다.]"
SENSITIVE_RULES = [
    r"\bsearch_knowledge_base\b",
    r"\bget_attached_file\b",
    r"(GOOGLE_API_KEY|GEMINI_API_KEY)\s*[=:]\s*\S+",
    r"(AWS_SECRET_ACCESS_KEY|AWS_ACCESS_KEY_ID)\s*[=:]\s*\S+",
    r"SESSION_SECRET\s*[=:]\s*\S+",
    r"\bchroma_db\b",
    r"\bCHROMA_DB_PATH\b",
    r"\bCHROMA_COLLECTION\b",
    r"\blanggraph_checkpoints\b",
    r"당신의 이름은 [^.\n]{1,40}입니다.{20,}",
    r"아래 지침을 따르세요.{10,}",
]
SAFE_MESSAGE = "요청하신 내용에 대한 답변을 제공하기 어렵습니다. 사내 업무 관련 질문을 입력해 주세요."
UNITS = "명|억|만원|만\\s*원|억\\s*원|시간|분|일|차|곳|개|단계|자|회|건|개월|년|％|%|원"
NUMBER = rf"(\d{{1,2}}:\d{{2}}|\d{{1,3}}(?:,\d{{3}})*(?:\.\d+)?(?:\s*(?:{UNITS}))?)"
NO_INFO_PHRASES = ["찾을 수 없습니다", "확인할 수 없습니다", "확인되지 않", "포함되어 있지 않", "정보가 없", "찾을 수 없다"]
COUNTED = "가지|개|단계|곳|명|항목|요소|축|영역"
NUMERALS = ["한", "두", "세", "네", "다섯", "여섯", "일곱", "여덟", "아홉", "열"]
BULLET = f"^(?:{tx.WS}|[•·\\-*\\p{{Nd}}.)\\]\\[])+"
CITATION = r"(?U)\[(\d{1,3})\]"
PERCENT_RUN = "@?(?:%[0-9A-Fa-f]{2}){3,}"
MAX_ISSUES, MAX_NUMBER_ISSUES, STRONG_SCORE, STRONG_HITS, SHORT_ANSWER = 5, 2, 0.7, 3, 200
CHECKED_ITEMS, CORE_CHARS, REPLAN_BELOW = 15, 30, 0.5
SKIPPED_BLOCKS = ["thinking", "redacted_thinking", "tool_use", "tool_result", "server_tool_use"]
FLAGS = "(?iuUd)"


def first_rule(text: Column, rules: Sequence[str]) -> Column:
    """Number of the first rule that matches, from 1; null where none does."""
    out = F.when(F.lit(False), F.lit(0))
    for n, rule in enumerate(rules, start=1):
        out = out.when(F.rlike(text, F.lit(FLAGS + rule)), F.lit(n))
    return out


def screen(df: DataFrame, text_col: str, rules: Sequence[str], message: str) -> DataFrame:
    """Replace a text that any rule matches by a message; adds ``blocked`` and ``rule``."""
    out = df.withColumn("rule", first_rule(F.col(text_col), rules))
    blocked = F.col("rule").isNotNull()
    return out.withColumn("blocked", blocked).withColumn(text_col, F.when(blocked, F.lit(message)).otherwise(F.col(text_col)))


def content_screen(df: DataFrame, text_col: str, rules: Sequence[str] = INJECTION_RULES) -> DataFrame:
    return screen(df, text_col, rules, BLOCK_MESSAGE)


def output_screen(df: DataFrame, text_col: str, rules: Sequence[str] = SENSITIVE_RULES) -> DataFrame:
    return screen(df, text_col, rules, SAFE_MESSAGE)


def screen_report(screened: DataFrame) -> DataFrame:
    """Blocked texts per rule."""
    return screened.filter("blocked").groupBy("rule").agg(F.count("*").alias("n"))


def text_blocks(content: Column) -> Column:
    """Text parts of a JSON content: a string, a list of typed blocks, or one block; reasoning and tool blocks are left out."""

    def string_of(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def of(v: Column) -> Column:
        def part(x: Column) -> Column:
            text = F.try_variant_get(x, "$.text", "variant")
            kind = F.try_variant_get(x, "$.type", "string")
            skipped = F.coalesce(kind.isin(SKIPPED_BLOCKS), F.lit(False))
            return tx.strip(F.coalesce(string_of(x), F.when(~skipped, string_of(text)), F.lit("")))

        parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), part), lambda t: t != "")
        kind = F.schema_of_variant(v)
        whole = F.coalesce(string_of(F.try_variant_get(v, "$.text", "variant")), F.to_json(v))
        return (
            F.when(v.isNull() | F.is_variant_null(v), F.lit(""))
            .when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, "\n"))
            .when(F.startswith(kind, F.lit("OBJECT")), tx.strip(whole))
            .otherwise(tx.strip(F.coalesce(string_of(v), F.to_json(v))))
        )

    return tx.let(F.try_parse_json(content), of)


REASON_CHARS = 500  # fixed value: length of a reasoning found by pattern
_VERDICT = "correct boolean, score_value double, reasoning string, missing array<string>, extra array<string>"


def tolerant_json(raw: Column, chars: int | None = REASON_CHARS) -> Column:
    """(correct, score_value, reasoning, stage, missing, extra) of a verdict text.

    Tried in turn: the text without its fence; what stands between its outer
    braces, line ends inside escaped; single fields by pattern, of the reasoning
    its first ``chars``; an error.
    """

    def is_object(j: Column) -> Column:
        return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(j)), F.lit("OBJECT")), F.lit(False))

    none = F.array().cast("array<string>")

    def result(correct: Column, score: Column, reason: Column, stage: str, missing: Column = none, extra: Column = none) -> Column:
        return F.struct(
            F.coalesce(correct, F.lit(False)).alias("correct"), F.coalesce(score, F.lit(0.0)).alias("score_value"),
            F.coalesce(reason, F.lit("")).alias("reasoning"), F.lit(stage).alias("stage"),
            F.coalesce(missing, none).alias("missing"), F.coalesce(extra, none).alias("extra"),
        )

    def parsed(j: Column, stage: str) -> Column:
        v = F.from_json(j, _VERDICT)
        return result(v["correct"], v["score_value"], v["reasoning"], stage, v["missing"], v["extra"])

    def of(s: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(s, r"(?s)(\{.*\})", 1), r"(?<!\\)\n", r"\\n")
        correct = F.lower(F.regexp_extract(s, r'(?i)"correct"\s*:\s*(true|false)', 1))
        score = F.regexp_extract(s, r'"score_value"\s*:\s*([0-9.]+)', 1)
        reason = F.regexp_extract(s, r'"reasoning"\s*:\s*"([^"]*)', 1)
        reason = reason if chars is None else F.left(reason, F.lit(chars))
        by_field = result(
            correct == "true", score.try_cast("double"),
            F.when(F.rlike(s, F.lit(r'"reasoning"\s*:\s*"')), reason).otherwise(F.lit("regex-extracted (parse fallback)")), "fields",
        )
        return (
            F.when(is_object(s), parsed(s, "whole"))
            .when(is_object(inner), parsed(inner, "braces"))
            .when((correct != "") | (score != ""), by_field)
            .otherwise(result(F.lit(False), F.lit(0.0), F.lit("judge JSON parse failed"), "error"))
        )

    return tx.let(tx.unfence(tx.strip(raw)), of)


def decode_percent_runs(text: Column) -> Column:
    """Text with runs of percent codes decoded where that yields letters; each run is judged in its place."""
    pieces = F.split(text, PERCENT_RUN, -1)
    runs = F.regexp_extract_all(text, F.lit(f"({PERCENT_RUN})"), 1)

    def decoded(run: Column) -> Column:
        def pick(plain: Column) -> Column:
            return F.when((plain != run) & F.rlike(plain, F.lit("[가-힣a-zA-Z]")), plain).otherwise(run)

        return tx.let(F.coalesce(F.try_url_decode(run), run), pick)

    joined = F.zip_with(pieces, F.transform(runs, decoded), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(F.contains(text, F.lit("%")), F.array_join(joined, "")).otherwise(text)


# ---------------------------------------------------------------- answers against hits


def answer_numbers(answer: Column) -> Column:
    """Distinct number tokens of an answer without white space, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(f"(?U){NUMBER}"), 1)
    return F.array_distinct(F.transform(found, tx.squeeze))


def hit_text(hits: DataFrame) -> DataFrame:
    """Joined texts of a query's hits without white space; a query has at most its final cut of hits."""
    packed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: tx.squeeze(x["content"])), "")
    return packed.select("query_id", text.alias("hit_text"), F.size("h").alias("n_hits"))


def first_of(items: Column, n: int | None) -> Column:
    """The first ``n`` elements; None leaves them all."""
    return items if n is None else F.slice(items, 1, n)


def unsupported_numbers(answer: Column, packed: Column, most: int | None = MAX_ISSUES) -> Column:
    """Issues for numbers of the answer that the hits do not hold, the first ``most`` of them."""
    missing = F.filter(answer_numbers(answer), lambda n: ~F.contains(packed, n))
    issues = F.transform(first_of(missing, most), lambda n: F.concat(F.lit("수치 '"), n, F.lit("' 검색 결과에 없음")))
    usable = (F.coalesce(answer, F.lit("")) != "") & packed.isNotNull()
    return F.when(usable, issues).otherwise(F.array().cast("array<string>"))


def no_info_misclaim(answers: DataFrame, hits: DataFrame, min_score: float = STRONG_SCORE, min_hits: int = STRONG_HITS) -> DataFrame:
    """Answers that claim to know nothing although enough strong hits were there: adds ``misclaim``."""
    strong = hits.filter(F.col("score") >= min_score).groupBy("query_id").agg(F.count("*").alias("_strong"))
    out = answers.join(strong, "query_id", "left")
    denies = (F.length("answer") < SHORT_ANSWER) & tx.contains_any(F.col("answer"), NO_INFO_PHRASES)
    return out.withColumn("misclaim", F.coalesce((F.col("_strong") >= min_hits) & denies, F.lit(False))).drop("_strong")


def expected_count(question: Column) -> Column:
    """Number of things a question asks for: digits before a counter word, else a numeral; null if none."""
    digits = F.regexp_extract(question, rf"(?U)(\d{{1,2}})\s*(?:{COUNTED})", 1)
    word = F.regexp_extract(question, rf"(?U)({'|'.join(NUMERALS)})\s*(?:{COUNTED})", 1)
    at = F.array_position(F.array(*[F.lit(n) for n in NUMERALS]), word)
    return F.when(digits != "", tx.ascii_digits(digits).try_cast("int")).when(word != "", at.cast("int"))


def list_items(answer: Column) -> Column:
    """Lines of an answer as list items, without bullets and citations, 2 to 200 characters long."""

    def clean(line: Column) -> Column:
        bare = tx.strip(F.regexp_replace(tx.strip(line), BULLET, ""))
        return tx.strip(F.regexp_replace(bare, f"{tx.WS}*\\[[0-9]{{1,3}}\\]{tx.WS}*", " "))

    rows = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), clean)
    return F.filter(rows, lambda x: F.length(x).between(2, 200))


def list_consistency(
    question: Column, answer: Column, packed: Column, checked: int | None = CHECKED_ITEMS, core_chars: int | None = CORE_CHARS, most: int | None = MAX_ISSUES
) -> Column:
    """Issues of a list answer: a wrong count, and items that the hits do not hold.

    Reported are the first ``most`` issues among the first ``checked`` items; an
    item counts as held if its first ``core_chars`` letters and digits are.
    """
    head = lambda text: text if core_chars is None else F.left(text, F.lit(core_chars))
    low = F.lower(packed)

    def issues(items: Column) -> Column:
        wanted = expected_count(question)
        count = F.when(
            F.coalesce(wanted, F.lit(0)).isin(0) | (F.size(items) == wanted), F.array().cast("array<string>")
        ).otherwise(F.array(F.format_string("list_n 개수 불일치: 질문 %d개 요구, 답변 %d개", wanted, F.size(items))))

        def absent(item: Column) -> Column:
            bare = F.lower(tx.squeeze(item))
            core = F.lower(head(F.regexp_replace(item, "[^가-힣a-zA-Z0-9]", "")))
            return (F.length(bare) >= 3) & ~F.contains(low, bare) & (F.length(core) >= 4) & ~F.contains(low, core)

        lost = F.transform(
            F.filter(first_of(items, checked), absent),
            lambda x: F.concat(F.lit("list_n 항목 '"), head(x), F.lit("' 검색 결과에 없음 (환각 의심)")),
        )
        return F.when(F.size(items) > 0, first_of(F.concat(count, lost), most)).otherwise(F.array().cast("array<string>"))

    return F.when(packed.isNotNull(), tx.let(list_items(answer), issues)).otherwise(F.array().cast("array<string>"))


def verdict(df: DataFrame) -> DataFrame:
    """Verdict on (number_issues, list_issues, misclaim, judge_passed, groundedness, relevance, hallucination_risk, replan_iterations)."""
    n_numbers, n_lists = F.size("number_issues"), F.size("list_issues")
    passed = F.coalesce("judge_passed", F.lit(True)) & ~F.col("misclaim") & (n_numbers <= MAX_NUMBER_ISSUES) & (n_lists == 0)
    g = F.coalesce("groundedness", F.lit(1.0))
    out = df.withColumn("passed", passed).withColumn("n_issues", n_numbers + n_lists)
    replan = ~F.col("passed") & (F.col("replan_iterations") < 1) & (g < REPLAN_BELOW)
    two = tx.two_digits
    good = F.concat(
        F.lit("reflect:pass(g="), two(g), F.lit(",r="), two(F.coalesce("relevance", F.lit(1.0))),
        F.lit(",h="), two(F.coalesce("hallucination_risk", F.lit(0.0))), F.lit(")"),
    )
    bad = F.concat(F.format_string("reflect:fail(facts=%d,miscalim=%s,g=", "n_issues", F.initcap(F.col("misclaim").cast("string"))), two(g), F.lit(")"))
    return out.withColumn("label", F.when(F.col("passed"), good).otherwise(bad)).withColumn("route", F.when(replan, "replan").otherwise("end"))


def cited_ids(answer: Column) -> Column:
    """Distinct numbers in ``[n]`` marks of an answer."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(CITATION), 1)
    return F.array_distinct(F.transform(found, lambda x: tx.ascii_digits(x).cast("int")))


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits whose rank the answer of their query cites."""
    cited = answers.select("query_id", F.explode(cited_ids(F.col("answer"))).alias("rank"))
    return hits.join(cited, ["query_id", "rank"], "left_semi")
