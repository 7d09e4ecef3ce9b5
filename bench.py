"""Wall seconds of the headline queries; prints one JSON line.

Session, Python workers and readers are warmed up first. Tables that several
queries share are built apart and timed as rows of their own, so that no query
pays for another; every query then counts with the median of three runs.
``search_blocks`` repeats the questions under new ids until there are several
blocks: seconds should grow in line with the questions.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_index", "bm25_search", "dense_search", "hybrid_search", "multi_query_pool", "expand_same_page", "nearest_class_route",
    "qa_cache_match", "text_sections", "adaptive_chunk", "split_text", "extract_entities", "markdown_table", "content_screen",
    "turn_pairs", "window_text", "reset_or_append", "ingest_apply", "ingest_state", "parse_question_list", "score_answers",
    "breakdown", "threshold_sweep", "recall_mrr", "rrf_sweep", "folder_rollup", "stream_routing_log",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
REPEATS = (1, 8)  # times the questions in the runs over one block and over several


def seconds(action) -> float:
    start = time.time()
    action()
    return time.time() - start


def main() -> None:
    from loomstone import build_session
    from loomstone.operators import lexical as lx
    from pyspark.sql import functions as F

    from workload import all_queries, base, corpus

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session("bench", f"local[{cpus}]", int(cpus))
        spark.sparkContext.setLogLevel("ERROR")
        consume = lambda df: df.write.format("noop").mode("overwrite").save()
        consume(spark.range(100_000).repartition(int(cpus)).mapInArrow(lambda batches: batches, "id long"))
        consume(base.table(spark, sf_dir, "documents").selectExpr("length(text)"))
        builds = {
            "build_lexical_index": lambda: base.lexical_index(spark, sf_dir),
            "build_item_facts": lambda: base.facts(spark, sf_dir),
            "build_question_hits": lambda: base.hits(spark, sf_dir, False),
            "build_units": lambda: corpus.units(spark, sf_dir),
        }
        build_times = {name: round(seconds(build), 3) for name, build in builds.items()} if wanted == HEADLINE else {}
        queries = all_queries()
        times = {name: round(median(seconds(lambda n=name: consume(queries[n](spark, sf_dir))) for _ in range(RUNS)), 3) for name in wanted}
        blocks = {}
        if wanted == HEADLINE:
            index, terms, _, avgdl = base.lexical_index(spark, sf_dir)
            q = base.questions(spark, sf_dir)
            for n in REPEATS:
                many = q.select((F.col("query_id") * n).alias("query_id"), "text").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
                many = many.select((F.col("query_id") + F.col("i")).alias("query_id"), "text")
                blocks[f"x{n}"] = round(seconds(lambda m=many: consume(lx.bm25_search(m, index, terms, avgdl, base.FETCH, query_block=200))), 3)  # noqa: B023
        spark.stop()
    total = round(sum(times.values()), 3)
    out = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "builds": build_times, "search_blocks": blocks}
    print(json.dumps({**out, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
