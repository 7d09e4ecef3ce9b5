"""What the operators of this subpackage share: word rule, shared tables, name clashes, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import fresh_path

# Fixed values of the word rule: a word is a run of anything but these six bytes.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


_SCOPES: list[list[str]] = []


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors re-read files.

    Inside ``scratch`` the table goes when the block ends, or, with ``keep``,
    when the block around it ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored in this block are removed at its end. What leaves it must have been stored with ``keep``, as its own files are all it needs."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            top = spark._jvm.org.apache.hadoop.fs.Path(path)
            top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts have no size bound, so tasks get them in batches of ``rows`` at most, whatever the session's own number is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """Hand freed memory of this worker back to the system, as the next task in it may be of another stage."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns whose names an operator is about to write, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``_row``, so that names an operator works with cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(columns: Iterable[str], **new: Column) -> list[Column]:
    """The columns of ``_row`` again; those named in ``new`` (any case) with their new values."""
    return [new[c.lower()].alias(c) if c.lower() in new else F.col(f"_row.`{c}`") for c in columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """With the id this names a document: rows that agree in both are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node reachable, for an undirected edge table (a, b).

    The graph is contracted round by round: every node joins the first of its
    neighbours and itself, edges inside a group go, and the rest are edges of a
    smaller graph. First is the smallest node in even rounds, which ends stars at
    once, and the smallest hash in odd ones, which halves chains whatever their
    order. Minima combine before the shuffle and no neighbour list is ever
    gathered; each round is a table in the shared folder.
    """
    with scratch(edges.sparkSession):
        return _contracted(edges)


def _contracted(edges: DataFrame) -> DataFrame:
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest, labels, turn = stored(pairs, "edges"), None, 0
    while True:
        both = rest.select("a", "b").unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = (lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c))) if turn % 2 else (lambda c: F.struct(F.col(c).alias("h"), F.col(c)))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        kind = first.schema["near"].dataType
        step = stored(first.select(F.col("a").alias("node"), F.least(rank("a").cast(kind), "near")[kind.names[1]].alias("to")), "step")
        for _ in range(2):  # follow the joins a little, as one may lead to the next
            on = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = step.join(on, "to").select("node", F.col("next").alias("to"))
        step = stored(step, "step")
        if labels is None:
            labels = step
        else:
            on = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            labels = stored(labels.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "labels")
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        rest = rest.join(left, "a").join(right, "b").where("x <> y")
        rest = stored(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        turn += 1
        if rest.isEmpty():
            break
    least = labels.groupBy("to").agg(F.least(F.min("node"), F.col("to")).alias("component"))
    return stored(labels.join(least, "to").select("node", "component"), "components", keep=True)
