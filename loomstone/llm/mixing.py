"""Mixing sources to target weights: per-source sizes, bounded targets, whole and hash-drawn copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import WORD, packed, stored, unpacked


def word_count(text: Column) -> Column:
    """Number of words; none for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without one task seeing them all.

    Rows are dealt by range and numbered inside their part; the sizes of the
    parts (one number each) give the offsets.
    """
    width = 33  # bits of a row's number inside its part in monotonically_increasing_id
    order = [F.col("source").isNull(), F.col("source")]
    numbered = stored(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()), "sources")
    numbered = numbered.withColumn("part", F.shiftright("n", width)).withColumn("n", F.col("n").bitwiseAND(F.lit((1 << width) - 1)))
    parts = numbered.groupBy("part").count()
    before = parts.alias("p").join(parts.alias("q"), F.expr("q.part < p.part"), "left").groupBy("p.part").agg(F.coalesce(F.sum("q.count"), F.lit(0)).alias("before"))
    return numbered.join(before, "part").withColumn("rank", F.col("before") + F.col("n")).drop("part", "n", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    The sources weigh ``weights`` in turn and share ``share`` times all sizes;
    a target stops at ``cap`` times its source's size and what is over goes to
    the others by weight until none is above. The level at which that ends is
    the fixed point of one small aggregate over the source table; each round
    only adds capped sources. A null source is a source; no rows, no targets.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap).drop("rank"), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("most") < F.lit(level) * F.col("weight")
        row = sources.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row["n"] == capped or not row["open"]:
            level = level if row["open"] else float("inf")
            break
        capped, level = row["n"], (share * total - row["full"]) / row["open"]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", F.when(F.col("most") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, doc_id: Column, seed: str) -> Column:
    """Whole copies, and one more if the document's draw is below the rest of the rate."""
    return (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def source_rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def mix(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mix of documents (doc_id, text, source, ...): every row as often as its source's rate and its draw say.

    A source's rate is target / size; a document gets floor(rate) copies and
    one more if its draw is below the rest. Rows of one id draw alike, so
    reruns and repeated rows agree; a source without words takes no copies;
    null texts count no words; a null source is a source. All columns come
    through, whatever their names. Targets are one small row per source; Spark
    broadcasts them only below its own size limit.
    """
    sizes = docs.select(F.col("source"), word_count(F.col("text")).alias("size"))
    targets = stored(source_targets(sizes, **options), "targets")
    joined = packed(docs).join(targets, F.col("_row.source").eqNullSafe(F.col("source")))
    many = joined.withColumn("_copies", copies(source_rate(), F.col("_row.doc_id"), seed)).where("_copies > 0")
    return many.withColumn("_copy", F.explode(F.expr("array_repeat(0, CAST(_copies AS INT))"))).select(*unpacked(docs.columns))


def mixture(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    The figures of ``mix``, with the same cases. Sizes are counted once and kept
    in the shared folder; only ids, sources and sizes move.
    """
    sized = stored(docs.select("doc_id", F.col("source").alias("_source"), word_count(F.col("text")).alias("size")), "sizes")
    targets = stored(source_targets(sized.select(F.col("_source").alias("source"), "size"), **options), "targets")
    joined = sized.join(targets, F.col("_source").eqNullSafe(F.col("source")))
    taken = (copies(source_rate(), F.col("doc_id"), seed) * F.col("size")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
