"""Streams over files that arrive in several batches."""

import re
import time

from pyspark.sql import functions as F

from loomstone.session import fresh_path
from loomstone.sources.manifests import last_version
from loomstone.streaming import jobs


def test_ingest_keeps_newest_and_skips_known(spark):
    base = fresh_path(spark, "arrive")
    schema = "path string, content string, modified int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")

    def run():
        files = spark.readStream.schema(schema).parquet(base + "/in")
        chunker = lambda d: d.select("path", "hash", F.posexplode(F.split("content", "\n")).alias("chunk_no", "text"))
        jobs.stream_ingest(files, base + "/log", base + "/cp", chunker).awaitTermination()
        return sorted((r["path"], r["chunk_no"], r["text"]) for r in jobs.current_chunks(spark, base + "/log").collect())

    arrive([("a", "one\ntwo", 1), ("b", "x", 1)])
    assert run() == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "x")]
    arrive([("a", "one\ntwo", 2), ("b", "y", 2), ("c", "z", 1), ("c", "zz", 2)])
    assert run() == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "y"), ("c", 0, "zz")]
    assert sorted(r["path"] for r in spark.read.parquet(base + "/log/chunks/batch=1").select("path").distinct().collect()) == ["b", "c"]
    assert run() == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "y"), ("c", 0, "zz")]
    arrive([("b", "older", 1), ("a", "between", 1), ("c", None, 3)])  # late versions change nothing, a row without content deletes
    assert run() == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "y")]
    arrive([("c", "older than the delete", 2), ("b", "z", 4)])
    assert run() == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "z")]
    arrive([("c", "back", 5)])
    assert run() == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, "z"), ("c", 0, "back")]


def test_thread_state_over_batches(spark):
    base = fresh_path(spark, "threads")
    schema = "thread string, turn long, text string"
    out = {}

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")

        def keep(batch, _):
            for r in batch.collect():
                out[r["thread"]] = tuple(r)[1:]

        states = jobs.stream_thread_state(spark.readStream.schema(schema).parquet(base + "/in"), 3)
        writer = states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", base + "/cp")
        jobs.run_available(writer, spark)

    run([("t", i, f"m{i}") for i in range(4)] + [("u", 0, "only")])
    assert out == {"t": (4, 3, 3, "m3"), "u": (1, 1, 0, "only")}
    run([("t", 9, "late")])
    assert out["t"] == (5, 3, 9, "late") and out["u"] == (1, 1, 0, "only")


def test_late_rows_are_dropped(spark):
    base = fresh_path(spark, "late")
    schema = "ts timestamp, route string"

    def run(rows):
        df = spark.createDataFrame(rows, "s string, route string").select(F.col("s").cast("timestamp").alias("ts"), "route")
        df.coalesce(1).write.mode("append").parquet(base + "/in")
        counts = jobs.routing_counts(jobs.watermarked(spark.readStream.schema(schema).parquet(base + "/in"), "ts"), "ts", "route")
        jobs.append_to(counts, base + "/out", base + "/cp").awaitTermination()

    run([("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:20", "a"), ("2024-01-01 01:00:00", "b")])
    run([("2024-01-01 00:00:30", "a"), ("2024-01-01 03:00:00", "b")])
    got = sorted((str(r["window_start"]), r["route"], r["n"]) for r in spark.read.schema("window_start timestamp, route string, n long").parquet(base + "/out").collect())
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)]


def test_ingest_reads_touched_buckets_and_folds_states(spark):
    base = fresh_path(spark, "folded")
    schema = "path string, content string, modified int"
    chunker = lambda d: d.select("path", "hash", F.lit(0).alias("chunk_no"), F.col("content").alias("text"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")
        files = spark.readStream.schema(schema).parquet(base + "/in")
        jobs.stream_ingest(files, base + "/log", base + "/cp", chunker, buckets=8, compact_after=2).awaitTermination()
        return last_version(spark, base + "/log")

    def text(version=None):
        return {r["path"]: r["text"] for r in jobs.current_chunks(spark, base + "/log", version).collect()}

    first = arrive([(f"p{i}", f"t{i}", 1) for i in range(40)])
    versions = [arrive([("p1", f"new {k}", 2 + k)]) for k in range(5)]
    assert text() == {f"p{i}": f"t{i}" for i in range(40)} | {"p1": "new 4"}
    assert max(len(v.generations) for v in versions) <= 3  # what a batch reads does not go by the batches before it
    one = jobs._states(spark, base + "/log", versions[-1], [3])
    every = jobs._states(spark, base + "/log", versions[-1])
    assert {r["bucket"] for r in one.select("bucket").distinct().collect()} == {3}
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = 3", one._jdf.queryExecution().toString()) and every.count() > one.count() > 0
    # a version before stays readable, and a write that died before its manifest is not seen
    assert text(first) == {f"p{i}": f"t{i}" for i in range(40)}
    n = versions[-1].number
    spark.createDataFrame([("p1", "gone", 99, n, 0)], "path string, hash string, modified int, chunks_in long, bucket int").write.partitionBy("bucket").parquet(f"{base}/log/state/generation={n}")
    spark.createDataFrame([(0, str(n))], "place int, generation string").write.json(f"{base}/log/manifests/_unfinished")
    assert text()["p1"] == "new 4"
    assert arrive([("p2", "next", 2)]).number > n and text()["p1"] == "new 4" and text()["p2"] == "next"


def test_thread_state_expires_and_takes_nulls(spark):
    base = fresh_path(spark, "expiry")
    schema = "thread string, turn long, text string"
    out = {}

    def run(rows, ttl):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base + "/in")

        def keep(batch, _):
            for r in batch.collect():
                out[r["thread"]] = tuple(r)[1:]

        states = jobs.stream_thread_state(spark.readStream.schema(schema).parquet(base + "/in"), 2, ttl)
        jobs.run_available(states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", base + "/cp"), spark)

    run([("t", 1, "a"), ("t", None, "b"), ("t", 2, None), ("t", 2, None)], 1_500)
    assert out == {"t": (4, 2, 2, None)}
    time.sleep(2)
    run([("t", 0, "after")], 1_500)
    assert out == {"t": (1, 1, 0, "after")}


def test_tables_arrive_as_a_file_or_as_a_folder(spark, tmp_path):
    """A table that is a folder of files arrives whole, as one that is a single file does."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from workload import all_queries

    docs = pa.table({"doc_id": [0, 1, 2], "text": ["a\nb", "c", "a\nb"]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    said = pa.table(
        {"conv_id": [0, 0, 1], "turn": [0, 1, 0], "role": ["user", "assistant", "user"], "text": ["x", "y", "z"]},
        pa.schema([("conv_id", pa.int64()), ("turn", pa.int32()), ("role", pa.string()), ("text", pa.string())]),
    )
    found = []
    for kind in ("file", "folder"):
        for name, rows in (("documents", docs), ("conversations", said)):
            at = tmp_path / kind / f"{name}.parquet"
            if kind == "file":
                at.parent.mkdir(exist_ok=True)
                pq.write_table(rows, at)
            else:
                at.mkdir(parents=True)
                pq.write_table(rows.slice(0, 2), at / "part-0.parquet")
                pq.write_table(rows.slice(2), at / "part-1.parquet")
        lines = all_queries()["stream_ingest"](spark, str(tmp_path / kind)).select("path", "chunk_no", "text").collect()
        threads = all_queries()["stream_thread_state"](spark, str(tmp_path / kind)).select("thread", "messages", "last_text").collect()
        found.append((sorted(map(tuple, lines)), sorted(map(tuple, threads))))
    assert found[0] == found[1]
    assert found[1] == (
        [("0", 0, "a"), ("0", 1, "b"), ("1", 0, "c"), ("2", 0, "a"), ("2", 1, "b")],
        [("0", 2, "y"), ("1", 1, "z")],
    )
