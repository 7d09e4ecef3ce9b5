"""Typed reading and writing of evaluation records, question lists, manifests and logs."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.blocks import per_block
from loomstone.plans.ordered import Mark, scan

SCHEMAS = {
    "questions": "id int, category string, category_name string, category_range array<int>, question string",
    "labels": (
        "id int, category string, question string, answer string, answer_type string, "
        "citation struct<doc_id:string,snippet:string,location:string>, alternative_answers array<string>, "
        "confidence double, needs_review boolean, _reasoning string, _error string"
    ),
    "results": (
        "id int, category string, question string, answer string, task_type string, question_type string, "
        "decision_path array<string>, citations array<struct<id:int,doc_id:string,snippet:string,score:double,location:string>>, "
        "retrieval_iterations int, replan_iterations int, llm_call_count int, elapsed_sec double, error string"
    ),
    "scored": (
        "id int, category string, question string, answer string, task_type string, decision_path array<string>, elapsed_sec double, error string, "
        "score struct<correct:boolean,score_value:double,method:string,reasoning:string,missing:array<string>,extra:array<string>,ground_truth:string>"
    ),
    "manifest": "doc_id string, original_name string, source_path string, extracted_path string, format string, char_count int",
}

# The header of a question list and what a full list holds; lengths in a log row.
QUESTION_HEADER = f"(?s)^([A-P])\\.{tx.WS}+(.+?){tx.WS}*\\((\\p{{Nd}}+)~(\\p{{Nd}}+)\\)$"
QUESTION_COUNT, CATEGORIES = 250, "ABCDEFGHIJKLMNOP"
LOG_CHARS, SNIPPET_CHARS = 2000, 500


# Ours: bytes of phrases in a block (an automaton takes some ten times as many), rows passed on at once.
PHRASE_BYTES, _FLUSH = 8 << 20, 65536


def read_eval_json(spark: SparkSession, path: str, kind: str, multiline: bool = True) -> DataFrame:
    """Records of one kind with their fixed schema; JSON arrays, or one record per line."""
    return spark.read.schema(SCHEMAS[kind]).json(path, multiLine=multiline)


def write_eval_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; the first column name carries the UTF-8 mark that spreadsheet programs look for."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def parse_question_list(lines: DataFrame, bucket: Column) -> DataFrame:
    """Questions of (list_id, pos, line): a header line names the category of the lines below it.

    Blank lines and lines above the first header are left out; ids run through
    the list. ``bucket`` cuts a long list into segments along ``pos``.
    """
    rows = lines.withColumn("line", tx.strip(F.col("line"))).filter("line <> ''")

    def part(n: int) -> Column:
        return F.regexp_extract("line", QUESTION_HEADER, n)

    is_head = F.rlike("line", F.lit(QUESTION_HEADER))
    head = F.struct(part(1).alias("letter"), part(2).alias("name"), part(3).cast("int").alias("first"), part(4).cast("int").alias("last"))
    rows = rows.withColumn("_is_head", is_head)
    rows = scan(
        rows, ["list_id"], ["pos"], bucket,
        lasts={"head": F.when(F.col("_is_head"), head)},
        sums={"_line": (~F.col("_is_head")).cast("long")},
        marks={"_above": Mark("_line", F.col("_is_head"), first=True)},
    )
    rows = rows.withColumn("id", F.col("_line") - F.col("_above"))
    return rows.filter(~F.col("_is_head") & F.col("head").isNotNull()).select(
        "list_id", "id", F.col("head.letter").alias("category"), F.col("head.name").alias("category_name"),
        F.col("head.first").alias("range_first"), F.col("head.last").alias("range_last"), F.col("line").alias("question"),
    )


def question_violations(questions: DataFrame, count: int = QUESTION_COUNT, categories: str = CATEGORIES) -> DataFrame:
    """What is wrong with each list: its size, missing categories, ids out of range."""
    outside = ~F.col("id").between(F.col("range_first"), F.col("range_last"))
    return questions.groupBy("list_id").agg(
        F.count("*").alias("questions"),
        F.concat_ws("", F.array_sort(F.collect_set("category"))).alias("categories"),
        F.count_if(outside).alias("out_of_range"),
    ).select("*", (F.col("questions") != count).alias("wrong_count"), (F.col("categories") != categories).alias("wrong_categories"))


def source_manifest(files: DataFrame) -> DataFrame:
    """(doc_id, original_name, format, char_count) of (path, text)."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?s)^(\.*[^.].*?)\.[^.]*$", "$1")
    slug = F.translate(stem, " []", "_")
    ext = F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))
    return files.select(slug.alias("doc_id"), name.alias("original_name"), F.col("path").alias("source_path"), ext.alias("format"), F.length("text").alias("char_count"))


def explode_source_map(source_map: DataFrame, docs: DataFrame) -> DataFrame:
    """Sources of each category in order with their block of the category's context.

    Long form, one row per (category, place): a category may name any number of
    documents, so the blocks are not joined into one cell. Sources without a
    document are left out.
    """
    wanted = source_map.select("category", F.posexplode("sources").alias("place", "doc_id"))
    block = F.concat(F.lit("=== [출처: "), F.col("doc_id").cast("string"), F.lit("] ===\n"), F.col("text"))
    return wanted.join(docs.select("doc_id", block.alias("block")), "doc_id")


def routing_log_rows(decisions: DataFrame, chars: int | None = LOG_CHARS) -> DataFrame:
    """Log rows of (log_id, ts, user_id, input_text, final_task, routing_debug JSON) with the debug figures beside it."""

    def named(col: str) -> Column:
        return F.coalesce(F.when(F.col(col) != "", F.col(col)), F.lit("unknown"))

    text = F.coalesce("input_text", F.lit(""))
    d = F.from_json("routing_debug", "mode string, decision string, top1_score string, margin string")
    return decisions.select(
        "log_id", F.unix_timestamp("ts").alias("timestamp"), named("user_id").alias("user_id"),
        (text if chars is None else F.left(text, F.lit(chars))).alias("input_text"), named("final_task").alias("final_task"), "routing_debug",
        *[F.coalesce(d[c], F.lit("")).alias(n) for c, n in (("mode", "mode"), ("decision", "semantic_decision"), ("top1_score", "top1_score"), ("margin", "margin"))],
    )


def append_routing_log(decisions: DataFrame, path: str, chars: int | None = LOG_CHARS) -> None:
    routing_log_rows(decisions, chars).write.mode("append").parquet(path)


def holders(phrases: DataFrame, texts: DataFrame, block: int = 16384, most_bytes: int = PHRASE_BYTES) -> DataFrame:
    """(query_id, item_id) where a text (item_id, text) holds a phrase (query_id, text) word for word; an empty phrase is held by all.

    The phrases go to the tasks in bounded blocks, as one automaton each, which
    passes over every text once however many phrases it knows. Texts stay in
    their row. A phrase given twice counts for each of its ids; null phrases
    and texts hold nothing.
    """
    kept = texts.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")

    def pack(table: pa.Table) -> dict[str, list[int]]:
        by_text: dict[str, list[int]] = {}
        for q, t in zip(table.column("query_id").to_pylist(), table.column("text").to_pylist()):
            if t is not None:
                by_text.setdefault(t, []).append(q)
        return by_text

    def search(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = ahocorasick.Automaton()
            for phrase, ids in sent.value.items():
                if phrase:
                    words.add_word(phrase, ids)
            words.make_automaton()
            everywhere = sent.value.get("", [])
            for batch in batches:
                ids, items = [], []
                for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                    found = {q for _, held in words.iter(text) for q in held} if len(words) else set()
                    found.update(everywhere)
                    ids.extend(found)
                    items.extend([i] * len(found))
                    if len(ids) >= _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], ["query_id", "item_id"])
                        ids, items = [], []
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], ["query_id", "item_id"])

        return kept.mapInArrow(run, "query_id long, item_id long")

    return per_block(phrases.select(F.col("query_id").cast("long").alias("query_id"), "text"), "query_id", block, pack, search, most_bytes)
