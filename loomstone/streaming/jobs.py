"""Structured Streaming jobs: ingest, routing counts, rate limits, thread state.

Every job runs the same code on a batch where arrival order does not matter.
Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomstone.sources.manifests import Version, commit, last_version

# Rate limit, state life. The watermark is ours.
RATE_LIMIT, RATE_WINDOW = 10, "1 minute"
WATERMARK = "10 minutes"
MAX_MESSAGES, TTL_MS = 40, 7 * 24 * 3600 * 1000
# Ours: hash buckets of ingest states, and generations after which they are folded into one.
BUCKETS, COMPACT_AFTER = 64, 16
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def routing_counts(log: DataFrame, ts: str, route: str, window: str = "1 minute") -> DataFrame:
    """Decisions per route and window."""
    counted = log.groupBy(F.window(ts, window).alias("w"), F.col(route).alias("route")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "route", "n")


def rate_limit(attempts: DataFrame, key: str, ts: str, limit: int = RATE_LIMIT, window: str = RATE_WINDOW) -> DataFrame:
    """Keys with more than ``limit`` attempts in a tumbling window."""
    counted = attempts.groupBy(F.window(ts, window).alias("w"), F.col(key)).agg(F.count("*").alias("attempts"))
    return counted.filter(F.col("attempts") > limit).select(key, F.col("w.start").alias("window_start"), "attempts")


def watermarked(stream: DataFrame, ts: str, delay: str = WATERMARK) -> DataFrame:
    return stream.withWatermark(ts, delay)


def append_to(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet folder, exactly once through its checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_available(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a stateful job over what has arrived and end.

    State that expires by the clock asks for one more batch after every batch,
    so batches without data are off for this run; they stay on for a job that
    goes on. State is kept in RocksDB, which list state with a life asks for; a
    job started otherwise sets that provider itself.
    """
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.stateStore.providerClass": _ROCKS}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()


# ---------------------------------------------------------------- ingest


def stream_ingest(
    files: DataFrame, log: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame], once: bool = True,
    buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Ingest (path, content, modified) rows as they arrive into an append-only log of versions.

    The newest version of a path, by (modified, hash), counts whatever the order
    of arrival: what arrives late and is older changes nothing. A row without
    content deletes its path. A newer version with the hash already held keeps
    its chunks. ``chunker`` maps (path, hash, content) to (path, hash, chunk_no,
    text).

    A batch writes a generation: its chunks, and its states (path, hash,
    modified, chunks_in) by hash bucket of the path. A manifest written last
    names the generations that count, so a batch that dies leaves the version
    before it readable, and a batch that runs twice finds nothing new. A batch
    reads the states of the buckets it touches only, and after ``compact_after``
    generations their states are folded into one, so what it reads goes by the
    paths held, not by the batches before it. One writer at a time; ``buckets``
    of a log stays as it began.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        version = last_version(spark, log)
        if len(version.generations) > compact_after:
            version = compact_states(spark, log, version)
        bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
        hashed = batch.withColumn("hash", F.sha2("content", 256)).withColumn("version", F.struct("modified", "hash"))
        # Hashes decide before any content moves; then only new contents are met again.
        newest = hashed.groupBy("path").agg(F.max("version").alias("version"))
        if not version.generations:
            fresh = newest.withColumn("held", F.lit(None).cast("string")).withColumn("held_in", F.lit(None).cast("long"))
        else:
            touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]
            known = _newest(_states(spark, log, version, touched))
            current = known.select("path", F.struct("modified", "hash").alias("was"), F.col("hash").alias("held"), F.col("chunks_in").alias("held_in"))
            fresh = newest.join(current, "path", "left").where(F.col("was").isNull() | (F.col("version") > F.col("was"))).drop("was")
        mine = version.number
        same = F.col("version.hash").eqNullSafe(F.col("held")) & F.col("held").isNotNull()
        state = fresh.select(
            "path", "version.hash", "version.modified", F.when(same, F.col("held_in")).otherwise(F.lit(mine).cast("long")).alias("chunks_in"), bucket.alias("bucket")
        )
        _write_states(state, log, mine)
        state = spark.read.schema(state.schema).parquet(f"{log}/state/generation={mine}")
        if state.isEmpty():
            return
        wanted = state.where(F.col("hash").isNotNull() & (F.col("chunks_in") == mine)).select("path", "hash")
        contents = hashed.where("content IS NOT NULL").join(wanted, ["path", "hash"], "left_semi").dropDuplicates(["path", "hash"])
        chunker(contents.select("path", "hash", "content")).write.mode("overwrite").parquet(f"{log}/chunks/batch={mine}")
        commit(spark, log, mine + 1, (*version.generations, str(mine)))

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _write_states(states: DataFrame, log: str, generation: int) -> None:
    """States by bucket, one file a bucket: rows of a bucket meet in one task, which holds a hash share of all paths."""
    states.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/state/generation={generation}")


def _states(spark: SparkSession, log: str, version: Version, touched: list[int] | None = None) -> DataFrame:
    """States of the generations of a version, of the touched buckets only where those are given."""
    base = f"{log}/state"
    rows = spark.read.option("basePath", base).parquet(*[f"{base}/generation={g}" for g in version.generations])
    return rows if touched is None else rows.where(F.col("bucket").isin(touched))


def _newest(states: DataFrame) -> DataFrame:
    """The newest state of every path."""
    rest = F.struct("hash", "modified", "chunks_in", "bucket")
    return states.groupBy("path").agg(F.max_by(rest, F.struct("modified", "hash", "generation")).alias("s")).select("path", "s.*")


def compact_states(spark: SparkSession, log: str, version: Version | None = None) -> Version:
    """Fold the states of all generations into one; chunks stay where they are. Deleted paths keep their state, as late rows ask for it."""
    version = version or last_version(spark, log)
    if len(version.generations) < 2:
        return version
    _write_states(_newest(_states(spark, log, version)), log, version.number)
    return commit(spark, log, version.number + 1, (str(version.number),))


def current_chunks(spark: SparkSession, log: str, version: Version | None = None) -> DataFrame:
    """Chunks of the newest version of every path that is not deleted; LookupError before the first batch."""
    version = version or last_version(spark, log)
    if not version.generations:
        raise LookupError(f"nothing was ingested into {log}")
    held = _newest(_states(spark, log, version)).where("hash IS NOT NULL").select("path", F.col("chunks_in").alias("batch"))
    chunks = spark.read.option("basePath", f"{log}/chunks").parquet(f"{log}/chunks").withColumn("batch", F.col("batch").cast("long"))
    return chunks.join(held, ["path", "batch"], "left_semi")


# ---------------------------------------------------------------- thread state

_STATE_OUT = "thread string, messages long, kept long, last_turn long, last_text string"


class LastMessages(StatefulProcessor):
    """The last ``n`` messages of a thread as list state and their count as value state, both gone ``ttl_ms`` after the last one."""

    def __init__(self, n: int, ttl_ms: int) -> None:
        self.n, self.ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn long, text string", self.ttl_ms)
        self.count = handle.getValueState("count", "messages long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = list(self.kept.get()) if self.kept.exists() else []
        kept = pd.DataFrame(held, columns=["turn", "text"], dtype=object).astype({"turn": "Int64"})
        count = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            count += len(frame)
            kept = pd.concat([kept, frame[["turn", "text"]].astype({"turn": "Int64", "text": object})])
            kept = kept.sort_values(["turn", "text"], na_position="first", kind="stable").tail(self.n)
        messages = [(None if pd.isna(t) else int(t), None if s is None or s is pd.NA else s) for t, s in zip(kept["turn"], kept["text"])]
        self.kept.put(messages)  # putting the list anew renews the life of every message in it
        self.count.update((count,))
        turn, text = messages[-1]
        out = pd.DataFrame({"thread": [None if key[0] is None else str(key[0])], "messages": [count], "kept": [len(messages)]})
        yield out.assign(last_turn=pd.array([turn], "Int64"), last_text=pd.Series([text], dtype=object))

    def close(self) -> None:
        pass


def stream_thread_state(messages: DataFrame, n: int = MAX_MESSAGES, ttl_ms: int = TTL_MS) -> DataFrame:
    """State per thread of a stream of (thread, turn, text): its last ``n`` messages, dropped ``ttl_ms`` after the last one.

    Reports what is kept after each batch. Rows of a thread reach the processor
    in bounded Arrow batches and only the last ``n`` of them are held, by (turn,
    text), nulls first. State lives in RocksDB and is taken up again from the
    checkpoint.
    """
    return messages.groupBy("thread").transformWithStateInPandas(LastMessages(n, ttl_ms), _STATE_OUT, "update", "ProcessingTime")
