"""Manifests: numbered lists of the generations that make a store, each written after the tables it names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

_DONE = "_SUCCESS"


@dataclass(frozen=True)
class Version:
    """The generations that make a store, oldest first, as a manifest names them."""

    number: int
    generations: tuple[str, ...]


def last_version(spark: SparkSession, store: str) -> Version:
    """The last version whose manifest was finished; version 0 holds nothing.

    The folder of manifests is listed by name alone; files are looked at from
    the newest manifest down to the first finished one.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifests")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(top)), reverse=True) if fs.exists(top) else []
    for name in names:
        at = f"{store}/manifests/{name}"
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{_DONE}")):
            named = spark.read.schema("place int, generation string").json(at).orderBy("place").collect()
            return Version(int(name[1:]), tuple(r["generation"] for r in named))
    return Version(0, ())


def commit(spark: SparkSession, store: str, number: int, generations: tuple[str, ...]) -> Version:
    """Write a manifest; an unfinished one of that number, left by a write that died, is replaced."""
    rows = spark.createDataFrame(list(enumerate(generations)), "place int, generation string")
    rows.coalesce(1).write.mode("overwrite").json(f"{store}/manifests/v{number:012d}")
    return Version(number, generations)
