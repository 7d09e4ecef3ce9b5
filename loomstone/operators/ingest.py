"""Incremental ingest and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx

# What a trusted label needs, lengths of stored texts, rows shown of failures.
CONFIDENCE_MIN, SNIPPET_CHARS, SAMPLE_CHARS, SHOWN_FAILURES = 0.7, 500, 500, 20


def ingest_diff(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    """Status of every path of the snapshot (path, hash) or the state (path, hash): new, updated, skipped or deleted."""
    now = snapshot.select("path", F.col("hash").alias("hash"))
    was = state.select("path", F.col("hash").alias("old_hash"))
    both = now.join(was, "path", "full_outer")
    status = (
        F.when(F.col("hash").isNull(), "deleted")
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("hash") == F.col("old_hash"), "skipped")
        .otherwise("updated")
    )
    return both.withColumn("status", status)


def ingest_chunks(chunks: DataFrame, diff: DataFrame, new_chunks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Chunk table after an ingest: chunks of touched paths go, those of new and updated paths come."""
    touched = diff.filter(F.col("status").isin("updated", "deleted")).select("path")
    added = new_chunks.join(diff.filter(F.col("status").isin("new", "updated")).select("path"), "path", "left_semi")
    if failed is not None:
        added = added.join(failed.select("path"), "path", "left_anti")
    return chunks.join(touched, "path", "left_anti").unionByName(added)


def ingest_state(state: DataFrame, diff: DataFrame, new_chunks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """State (path, hash, chunk_ids) after an ingest.

    A failed path keeps its old row, or none, so that the next run tries it
    again. A path without chunks is treated the same way.
    """
    ids = new_chunks.groupBy("path").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    done = diff.filter(F.col("status").isin("new", "updated")).select("path", "hash").join(ids, "path")
    if failed is not None:
        done = done.join(failed.select("path"), "path", "left_anti")
    gone = diff.filter("status = 'deleted'").select("path")
    kept = state.join(done.select("path").unionByName(gone), "path", "left_anti")
    return kept.select("path", "hash", "chunk_ids").unionByName(done)


def ingest_report(diff: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Paths per outcome."""
    out = diff.select("path", "status")
    if failed is not None:
        out = out.join(failed.select("path", F.lit(True).alias("_failed")), "path", "left")
        out = out.withColumn("status", F.when(F.col("_failed"), "failed").otherwise(F.col("status")))
    return out.groupBy("status").agg(F.count("*").alias("n"))


def failed_paths(failed: DataFrame, n: int = SHOWN_FAILURES) -> DataFrame:
    return failed.select("path").orderBy("path").limit(n)


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a table as a new version beside the old ones and return its path."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


# ---------------------------------------------------------------- keyed tables


def capped(text: Column, chars: int | None) -> Column:
    """First ``chars`` of a text; None leaves it whole."""
    return text if chars is None else F.left(text, F.lit(chars))


def valid_entries(entries: DataFrame, snippet_chars: int | None = SNIPPET_CHARS) -> DataFrame:
    """Cache entries with an id, a question and an answer, texts trimmed and defaults set."""

    def clean(c: str) -> Column:
        return tx.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))

    def given(c: str, default: str) -> Column:
        return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(default))

    out = entries.select(
        clean("id").alias("id"), clean("question").alias("question"), clean("answer").alias("answer"), given("doc_id", "").alias("doc_id"),
        capped(given("snippet", ""), snippet_chars).alias("snippet"), given("location", "").alias("location"), given("answer_type", "reasoning").alias("answer_type"),
    )
    return out.filter((F.col("id") != "") & (F.col("question") != "") & (F.col("answer") != ""))


def one_per_id(fresh: DataFrame) -> DataFrame:
    """The greatest valid entry of each id."""
    rest = [c for c in fresh.columns if c != "id"]
    best = F.max(F.struct("question", "answer", *[c for c in rest if c not in ("question", "answer")])).alias("f")
    return fresh.groupBy("id").agg(best).select("id", *[F.col(f"f.{c}") for c in rest])


def upsert_counts(table: DataFrame, entries: DataFrame) -> DataFrame:
    """What an upsert does, one row: entries given, ids written, of them replaced and added, and entries that are not written."""
    ids = valid_entries(entries).select("id").distinct()
    held = table.select("id", F.lit(True).alias("_held")).distinct()
    written = ids.join(held, "id", "left").agg(F.count("*").alias("written"), F.count("_held").alias("replaced"))
    given = entries.agg(F.count("*").alias("given"))
    out = given.withColumn("_k", F.lit(1)).join(written.withColumn("_k", F.lit(1)), "_k")
    return out.select("given", "written", "replaced", (F.col("written") - F.col("replaced")).alias("added"), (F.col("given") - F.col("written")).alias("left_out"))


def upsert_by_id(table: DataFrame, entries: DataFrame) -> DataFrame:
    """Table with the valid entries in place of rows with their ids.

    Of entries that share an id the greatest by (question, answer, doc_id,
    snippet, location, answer_type) stays, so that an id is never held twice.
    """
    fresh = one_per_id(valid_entries(entries))
    return table.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def insert_if_absent(table: DataFrame, rows: DataFrame, chars: int | None = SAMPLE_CHARS) -> DataFrame:
    """Table of (task, text, source, created_at) with the rows whose trimmed (task, text) it lacks, the earliest of equals."""
    fresh = rows.withColumn("text", capped(tx.strip(F.col("text")), chars)).filter((F.col("task") != "") & (F.col("text") != ""))
    fresh = fresh.groupBy("task", "text").agg(F.min(F.struct("created_at", "source")).alias("f"))
    fresh = fresh.select("task", "text", "f.source", "f.created_at")
    return table.unionByName(fresh.join(table.select("task", "text"), ["task", "text"], "left_anti"))


def reset_by_source(table: DataFrame, seeds: DataFrame, source: str = "seed") -> DataFrame:
    """Table of (task, text, source, created_at) with all rows of one source replaced by the seeds (task, text, created_at).

    A (task, text) is held once: a seed takes the place of a row of another
    source. Other rows of other sources stay; of equal seeds the latest counts.
    """
    fresh = seeds.groupBy("task", "text").agg(F.lit(source).alias("source"), F.max("created_at").alias("created_at"))
    kept = table.filter(~F.col("source").eqNullSafe(source)).join(fresh.select("task", "text"), ["task", "text"], "left_anti")
    return kept.select("task", "text", "source", "created_at").unionByName(fresh)


def resume(done: DataFrame, todo: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``todo`` that ``done`` lacks."""
    return todo.join(done.select(key), key, "left_anti")


def select_eval_subset(questions: DataFrame, ids: DataFrame | None = None, categories: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Questions by id list, else by category, then the first ones by id."""
    out = questions
    if ids is not None:
        out = out.join(ids.select("id"), "id", "left_semi")
    elif categories:
        out = out.filter(F.col("category").isin(categories))
    return out.orderBy("id").limit(limit) if limit else out


def trust(labels: DataFrame, min_confidence: float = CONFIDENCE_MIN) -> DataFrame:
    """Add why a label is not trusted, or ``trusted``: marked for review, or not sure enough; no figure counts as sure."""
    sure = F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0))
    why = F.when(F.coalesce("needs_review", F.lit(False)), "needs_review").when(sure < min_confidence, "low_confidence").otherwise("trusted")
    return labels.withColumn("trust", why)
