"""A BM25 index that grows by ingests: a base, signed deltas on it, and a compaction that folds them.

A store is a folder of generations. A generation holds the forward rows of the
paths it brought (``rows``), the paths it touched (``touched``), and what it
adds to the document frequencies and totals (``terms``, ``totals``; negative for
what went). A path's rows count in the latest generation that touched it. Sums
of the deltas give exactly the statistics of an index built anew, so an ingest
cuts up the texts of touched paths only.

A manifest, written after all tables of its generation, names the generations
that make the index. Readers go by the last manifest, so a write that dies
leaves the version before it as it was, and its tables are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import lexical as lx
from loomstone.sources.manifests import Version, commit, last_version

ROWS = "path string, item_id long, dl int, counts array<struct<term:string,tf:int>>"
TABLES = {"rows": ROWS, "touched": "path string", "terms": "term string, df long, cf long", "totals": "n long, chars long"}

current = last_version


def _table(spark: SparkSession, store: str, version: Version, name: str) -> DataFrame:
    """A table of all generations of a version with the place of its generation as ``gen``."""
    out = spark.createDataFrame([], f"{TABLES[name]}, gen int")
    for gen, folder in enumerate(version.generations):
        part = spark.read.schema(TABLES[name]).parquet(f"{store}/{folder}/{name}").withColumn("gen", F.lit(gen))
        out = part if gen == 0 else out.unionByName(part)
    return out


def live_rows(spark: SparkSession, store: str, version: Version | None = None) -> DataFrame:
    """Forward rows (path, item_id, dl, counts) that count: those of the latest generation that touched their path."""
    version = version or current(spark, store)
    rows = _table(spark, store, version, "rows")
    later = _table(spark, store, version, "touched").where("gen > 0").groupBy("path").agg(F.max("gen").alias("last"))
    if len(version.generations) < 2:
        return rows.drop("gen")
    kept = rows.join(later, "path", "left").where(F.col("last").isNull() | (F.col("gen") >= F.col("last")))
    return kept.select("path", "item_id", "dl", "counts")


def _signed(rows: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    terms = rows.select(F.explode("counts").alias("c")).groupBy(F.col("c.term").alias("term"))
    terms = terms.agg((F.count("*") * sign).alias("df"), (F.sum(F.col("c.tf").cast("long")) * sign).alias("cf"))
    totals = rows.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0)) * sign).alias("chars"))
    return terms, totals


def _write(spark: SparkSession, path: str, rows: DataFrame, touched: DataFrame, gone: DataFrame | None) -> None:
    """The tables of a generation; statistics are summed over the written rows, not over texts again."""
    rows.write.parquet(f"{path}/rows")
    touched.write.parquet(f"{path}/touched")
    terms, totals = _signed(spark.read.schema(ROWS).parquet(f"{path}/rows"), 1)
    if gone is not None:
        less, fewer = _signed(gone, -1)
        terms = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 OR cf <> 0")
        totals = totals.unionByName(fewer).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    terms.write.parquet(f"{path}/terms")
    totals.write.parquet(f"{path}/totals")


def ingest(spark: SparkSession, store: str, touched: DataFrame, chunks: DataFrame) -> Version:
    """Bring one ingest into the store.

    ``touched`` holds every path that is new, changed or deleted; ``chunks`` is
    (path, chunk_id, content) of the new and changed ones, and chunks of other
    paths are left out. Paths are not null; a path given twice counts once.
    Chunks without text are no items, as in ``forward_index``.
    """
    version = current(spark, store)
    folder = f"generations/{uuid.uuid4().hex}"
    paths = touched.select("path").distinct()
    mine = chunks.join(paths, "path", "left_semi")
    items = lx.forward_index(mine, keep=["path"]).select("path", "item_id", "dl", "counts")
    gone = live_rows(spark, store, version).join(paths, "path", "left_semi") if version.generations else None
    _write(spark, f"{store}/{folder}", items, paths, gone)
    return commit(spark, store, version.number + 1, (*version.generations, folder))


def compact(spark: SparkSession, store: str) -> Version:
    """Fold all generations into one. Old ones stay on disk for readers that began before."""
    version = current(spark, store)
    if len(version.generations) < 2:
        return version
    folder = f"generations/{uuid.uuid4().hex}"
    rows = live_rows(spark, store, version)
    _write(spark, f"{store}/{folder}", rows, rows.select("path").distinct(), None)
    return commit(spark, store, version.number + 1, (folder,))


def open_index(spark: SparkSession, store: str, version: Version | None = None) -> tuple[DataFrame, DataFrame, int, float]:
    """What ``bm25_search`` reads: forward rows, term table with weights, number of items and their mean length."""
    version = version or current(spark, store)
    sums = _table(spark, store, version, "totals").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).first()
    n, length = int(sums["n"] or 0), int(sums["chars"] or 0)
    terms = _table(spark, store, version, "terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
    terms = lx.with_idf(terms, n)
    index = live_rows(spark, store, version).select("item_id", "dl", "counts")
    return index, lx.with_floor(terms, lx.mean_idf(terms)), n, length / n if n else 0.0
