"""File scans, formats and admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.session import source_files

# Suffixes taken in, formats, size limit, first bytes per suffix.
SUFFIXES = [".txt", ".md", ".pdf", ".docx", ".xlsx", ".xlsm", ".pptx"]
FORMATS = {
    ".pptx": "pptx", ".ppt": "pptx",
    ".pdf": "pdf",
    ".docx": "docx", ".doc": "docx",
    ".xlsx": "xlsx", ".xlsm": "xlsx", ".xls": "xlsx",
    ".txt": "txt",
    ".md": "md",
}
SUPPORTED_FORMATS = ["pptx", "pdf", "docx", "txt", "md", "xlsx"]
MAX_BYTES = 20 * 1024 * 1024
SIGNATURES = {".pdf": "%PDF", ".docx": "PK\x03\x04", ".xlsx": "PK\x03\x04", ".xlsm": "PK\x03\x04", ".pptx": "PK\x03\x04"}


def suffix(path: Column) -> Column:
    """Lower-case extension of the last path part, with its dot; empty if it has none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))


def scan_corpus(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES, with_content: bool = False) -> DataFrame:
    """Files below a folder with a wanted suffix: (path, file, suffix, size, modified[, content]).

    ``path`` is relative to the folder. Without content only the listing is
    read. Hidden files (a leading dot) are left out. Spark's file sources also
    pass over names that begin with an underscore, so such files must be renamed
    on the way in; ``underscored`` tells which there are.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    at = F.locate(base.split("://")[-1] + "/", rel)
    rel = F.substring(rel, at + len(base.split("://")[-1]) + 1, F.lit(2**31 - 1))
    cols = [rel.alias("path"), F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    return wanted_files(files.select(*cols, *(["content"] if with_content else [])), suffixes)


def wanted_files(listing: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Rows of a listing with a ``path`` whose suffix is wanted and whose name is not hidden (a leading dot); adds ``suffix``."""
    name = F.element_at(F.split("path", "/"), -1)
    out = listing.withColumn("suffix", suffix(F.col("path")))
    return out.filter(F.col("suffix").isin(list(suffixes)) & ~F.startswith(name, F.lit(".")))


def underscored(spark: SparkSession, root: str) -> list[str]:
    """Files below a folder that ``scan_corpus`` cannot see because a part of their path begins with an underscore."""
    base = root.rstrip("/").split("://")[-1]
    inner = [(path, path.split(base + "/", 1)[-1]) for path, *_ in source_files(spark, root)]
    return [path for path, rest in inner if any(part.startswith("_") for part in rest.split("/"))]


def classify_format(ext: Column) -> Column:
    """Format of an extension, ``unknown`` if it has none."""
    out = F.lit("unknown")
    for k, v in FORMATS.items():
        out = F.when(F.lower(ext) == k, F.lit(v)).otherwise(out)
    return out


def is_supported(fmt: Column) -> Column:
    return fmt.isin(SUPPORTED_FORMATS)


def signature_matches(content: Column, ext: Column) -> Column:
    """True if the first bytes fit the suffix; a suffix without a known signature passes."""
    out = F.lit(True)
    for k, v in SIGNATURES.items():
        out = F.when(F.lower(ext) == k, F.substring(content, 1, len(v)) == F.lit(v.encode("latin-1"))).otherwise(out)
    return out


def file_admission(files: DataFrame, max_bytes: int = MAX_BYTES, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Add ``admission`` to (suffix, size, content): what an upload is refused for, or ``accepted``."""
    why = (
        F.when(~F.lower("suffix").isin(list(suffixes)), "unsupported_suffix")
        .when(F.col("size") > max_bytes, "too_large")
        .when(~signature_matches(F.col("content"), F.col("suffix")), "content_mismatch")
        .otherwise("accepted")
    )
    return files.withColumn("admission", why)


def content_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)
