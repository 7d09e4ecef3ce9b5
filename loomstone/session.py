"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "loomstone", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume; cluster settings given at submit time win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where nothing is
    named and the master is local does a temporary folder stand in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="loomstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    import uuid

    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors cost a re-read of files."""
    path, schema = fresh_path(df.sparkSession, name), df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the file system of a path holds a folder there."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(top) and fs.getFileStatus(top).isDirectory()


def source_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of the files of a table, as its file system lists them."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found, walk = [], fs.listFiles(top, True)
    while walk.hasNext():
        status = walk.next()
        found.append((status.getPath().toString(), int(status.getLen()), int(status.getModificationTime())))
    return sorted(found)


_STAGED: dict[tuple, str] = {}


def staged(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """Write a table once per application and state of its sources, and read it back.

    Several consumers then share one scan of the sources. ``sources`` are the
    paths the table is made from; files that came, went or changed since make it
    anew.
    """
    state = [source_files(spark, p) for p in sources]
    slot = (spark.sparkContext.applicationId, name, hashlib.sha256(repr((sources, state)).encode()).hexdigest())
    if slot not in _STAGED:
        path = fresh_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _STAGED[slot] = path
    return spark.read.parquet(_STAGED[slot])
