"""File-estate inventory over (path, size, mtime) listings with ``/`` separated paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.ordered import top_rows

# Format buckets, pruned folders, name hints, version marks, limits.
SUPPORTED = [".pdf", ".docx", ".pptx", ".xlsx", ".xlsm", ".txt", ".md"]
NEEDS_WORK = [".hwp", ".hwpx", ".doc", ".ppt", ".xls"]
IGNORED = [".lnk", ".tmp", ".ini", ".db", ".ds_store", ".url", ".exe", ".dll"]
BUCKETS = {"supported": "지원", "needs_work": "변환필요", "ignored": "무시", "other": "기타"}
PRUNED_STARTS = ["$", "~", "."]
PRUNED_NAMES = ["@recycle", "system volume information"]
HINTS = [
    "급여", "연봉", "인사", "평가", "고과", "징계", "개인정보", "주민",
    "이력서", "계약", "견적", "세금계산서", "매출", "원가", "정산",
    "임원", "이사회", "지분", "투자", "감사", "법무", "소송",
]
VERSION_MARK = (
    r"[\s_\-(]*(최종|final|fin|수정본?|복사본|사본|copy|백업|backup|"
    r"v\d+(\.\d+)*|ver\d*|\d{1,2}차|rev\d*|\(\d+\)|_\d{6,8})[\s_\-)]*"
)
SAMPLES, TOP_EXT, RECENT_DAYS, SHOWN_SUBFOLDERS = 8, 20, 3 * 365, 5


def file_parts(listing: DataFrame, root: str) -> DataFrame:
    """Add folder, name and lower-case ext, without files under system folders."""
    rel = F.substring("path", len(root.rstrip("/")) + 2, 2**31 - 1)
    parts = F.split(rel, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    pruned = F.exists(
        folders, lambda f: F.lower(f).isin(PRUNED_NAMES) | F.substring(f, 1, 1).isin(PRUNED_STARTS)
    )
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))
    out = listing.withColumn("folders", folders).withColumn("name", name).withColumn("ext", ext)
    return out.filter(~pruned)


def folder_group(folders: Column, root: str, depth: int = 2) -> Column:
    """Folder a file is reported under: its first ``depth`` folders below the root."""
    return F.array_join(F.concat(F.array(F.lit(root.rstrip("/"))), F.slice(folders, 1, depth)), "/")


def file_bucket(ext: Column) -> Column:
    return (
        F.when(ext.isin(SUPPORTED), BUCKETS["supported"])
        .when(ext.isin(NEEDS_WORK), BUCKETS["needs_work"])
        .when(ext.isin(IGNORED) | (ext == ""), BUCKETS["ignored"])
        .otherwise(BUCKETS["other"])
    )


def classified(listing: DataFrame, root: str, depth: int = 2) -> DataFrame:
    files = file_parts(listing, root)
    return files.withColumn("group", folder_group(F.col("folders"), root, depth)).withColumn("bucket", file_bucket(F.col("ext")))


def sensitive_hints(files: DataFrame, root: str, hints: Sequence[str] = HINTS) -> DataFrame:
    """Hint words in folder or file names, one row per folder group and word; ignored files count with their folder only."""
    folder = F.concat(F.lit(root.rstrip("/") + "/"), F.array_join("folders", "/"))
    words = F.array(*[F.lit(h) for h in hints])
    counted = F.col("bucket") != BUCKETS["ignored"]
    found = F.filter(words, lambda w: F.contains(folder, w) | (counted & F.contains(F.col("name"), w)))
    return files.select("group", F.explode(found).alias("hint")).distinct()


def folder_rollup(files: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per folder group: counts, bytes, buckets, newest and oldest, extensions, sample names.

    Ignored files are counted as such and stay out of every other figure.
    """
    counted = F.col("bucket") != BUCKETS["ignored"]
    totals = files.groupBy("group").agg(
        F.count_if(counted).alias("files"),
        F.coalesce(F.sum(F.when(counted, F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
        *[F.count_if(F.col("bucket") == b).alias(k) for k, b in BUCKETS.items()],
        F.max(F.when(counted, F.col("mtime"))).alias("newest"),
        F.min(F.when(counted, F.col("mtime"))).alias("oldest"),
    )
    real = files.filter(counted)
    exts = real.groupBy("group", "ext").agg(F.count("*").alias("n"))
    exts = exts.groupBy("group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ext", "n"))), lambda x: F.concat(x["ext"], F.lit(":"), x["n"].cast("string"))), " ").alias("exts")
    )
    shown = top_rows(real.select("group", "name", "path"), ["group"], [F.col("name"), F.col("path")], samples)
    shown = shown.groupBy("group").agg(_listed("name", "samples"))
    out = totals.join(exts, "group", "left").join(shown, "group", "left")
    return out.fillna({"exts": "", "samples": ""})


def subfolders(files: DataFrame, depth: int = 2, shown: int = SHOWN_SUBFOLDERS) -> DataFrame:
    """Number of direct subfolders per folder group and the names of the first few."""
    subs = files.filter(F.size("folders") > depth).select("group", F.element_at("folders", depth + 1).alias("sub")).distinct()
    n = subs.groupBy("group").agg(F.count("*").alias("subfolders"))
    first = top_rows(subs, ["group"], [F.col("sub")], shown).groupBy("group").agg(_listed("sub", "first_subfolders"))
    return n.join(first, "group")


def _listed(col: str, name: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", col))), lambda x: x[col]), " / ").alias(name)


def normalize_name(name: Column) -> Column:
    """File name without extension and without version marks, which are taken off until none is left."""
    stem = F.regexp_replace(name, r"(?s)^(\.*[^.].*?)\.[^.]*$", "$1")
    less = lambda s: tx.strip(F.regexp_replace(s, f"(?iuU){VERSION_MARK}", ""))
    # A round that takes marks off shortens the name, so its length bounds the rounds; a name that stayed the same is done.
    step = lambda s, _: F.when(s["now"] == s["before"], s).otherwise(F.struct(less(s["now"]).alias("now"), s["now"].alias("before")))
    start = F.struct(less(stem).alias("now"), stem.alias("before"))
    bare = F.aggregate(F.sequence(F.lit(0), F.length(stem)), start, step, lambda s: s["now"])
    return F.lower(F.regexp_replace(bare, f"{tx.WS}+", ""))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Convertible files that share a bare name and a size: (bare_name, size, files, wasted_bytes)."""
    kept = files.filter(F.col("bucket").isin(BUCKETS["supported"], BUCKETS["needs_work"]))
    named = kept.withColumn("bare_name", normalize_name(F.col("name")))
    groups = named.groupBy("bare_name", "size").agg(F.count("*").alias("files")).filter("files > 1")
    return groups.withColumn("wasted_bytes", F.col("size") * (F.col("files") - 1))


def extension_top(files: DataFrame, n: int = TOP_EXT) -> DataFrame:
    counted = files.filter(F.col("bucket") != BUCKETS["ignored"])
    return counted.groupBy("ext").agg(F.count("*").alias("files")).orderBy(F.col("files").desc(), "ext").limit(n)


def recency_flag(rollup: DataFrame, as_of: Column, days: int = RECENT_DAYS) -> DataFrame:
    """Day of the newest file and whether it lies within the last years; groups without files are left out."""
    newest = F.timestamp_seconds("newest")
    return rollup.filter("files > 0").select(
        "group", F.date_format(newest, "yyyy-MM-dd").alias("newest_day"), (F.col("newest") >= as_of - days * 86400).alias("recent")
    )


def estate_summary(files: DataFrame, duplicates: DataFrame, denied: int | DataFrame = 0) -> DataFrame:
    """One row: totals, buckets, folder groups, duplicate waste and refused paths; ``denied`` is their number or a listing with that column."""
    counted = F.col("bucket") != BUCKETS["ignored"]
    totals = files.agg(
        F.count_if(counted).alias("total_files"),
        F.round(F.coalesce(F.sum(F.when(counted, F.col("size"))), F.lit(0)) / 1024**3, 6).alias("total_gb"),
        *[F.count_if(F.col("bucket") == b).alias(k) for k, b in BUCKETS.items()],
    )
    refused = files.sparkSession.range(1).select(F.lit(denied).cast("long").alias("access_denied")) if isinstance(denied, int) else denied.agg(F.count_if("denied").alias("access_denied"))
    groups = files.filter(counted).select("group").distinct().agg(F.count("*").alias("folder_groups"))
    dup = duplicates.agg(
        F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("files"), F.lit(0)).alias("duplicate_files"),
        F.round(F.coalesce(F.sum("wasted_bytes"), F.lit(0)) / 1024**3, 9).alias("duplicate_waste_gb"),
    )
    key = F.lit(1).alias("_k")
    return totals.select("*", key).join(refused.select("*", key), "_k").join(groups.select("*", key), "_k").join(dup.select("*", key), "_k").drop("_k")
