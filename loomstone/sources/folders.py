"""A listing of folders as a data source: tasks list, every name is seen, folders that refuse are rows too."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomstone.sources.files import SUFFIXES, wanted_files

SCHEMA = "path string, file string, size long, modified timestamp, denied boolean"
_ARROW = pa.schema([("path", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("denied", pa.bool_())])
_ROWS = 8192  # rows of a batch
TASKS = 64


def open_root(root: str) -> tuple[pafs.FileSystem, str, str]:
    """File system of a folder, the folder in its terms, and what stands before a path of it."""
    local = re.sub(r"^file:/+", "/", root)
    if "://" not in local:
        return pafs.LocalFileSystem(), os.path.abspath(local), ""
    system, path = pafs.FileSystem.from_uri(root)
    return system, path.rstrip("/"), root[: root.index("://") + 3]


def listed(system: pafs.FileSystem, folder: str) -> tuple[list[pafs.FileInfo], list[str]] | None:
    """Files and folders directly in a folder, without links to folders; None if it refuses, both empty if it is gone."""
    try:
        infos = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return None
    files = [i for i in infos if i.type == pafs.FileType.File]
    inner = [i.path for i in infos if i.type == pafs.FileType.Directory]
    if isinstance(system, pafs.LocalFileSystem):
        inner = [p for p in inner if not os.path.islink(p)]
    return files, sorted(inner)


def walk(system: pafs.FileSystem, top: str, folder: str, deep: bool, suffixes: Sequence[str] | None) -> Iterator[tuple]:
    """(path, file, size, modified in microseconds, denied) of a folder's files, and below it where ``deep``."""
    left = [folder]
    while left:
        at = left.pop()
        found = listed(system, at)
        if found is None:
            yield at[len(top) + 1 :], at, None, None, True
            continue
        for info in found[0]:
            name = info.base_name
            if suffixes is None or (not name.startswith(".") and os.path.splitext(name)[1].lower() in suffixes):
                yield info.path[len(top) + 1 :], info.path, info.size, None if info.mtime_ns is None else info.mtime_ns // 1000, False
        if deep:
            left.extend(found[1])


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


def plan(system: pafs.FileSystem, top: str, tasks: int) -> list[Folder]:
    """Folders to list, one a task: from the top down until there are ``tasks`` of them, so at most ``tasks`` are listed to plan."""
    alone, whole = [], [top]
    while whole and len(alone) < tasks and len(alone) + len(whole) < tasks:
        at = whole.pop(0)
        alone.append(at)
        whole.extend((listed(system, at) or ([], []))[1])
    return [Folder(p, False) for p in alone] + [Folder(p, True) for p in whole]


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.tasks = options["root"], int(options.get("tasks", TASKS))
        self.suffixes = json.loads(options.get("suffixes", "null"))

    def partitions(self) -> list[Folder]:
        system, top, _ = open_root(self.root)
        if system.get_file_info(top).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder: {self.root}")
        return plan(system, top, self.tasks)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, top, before = open_root(self.root)
        held: list[tuple] = []
        for row in walk(system, top, partition.path, partition.deep, self.suffixes):
            held.append((row[0], before + row[1], *row[2:]))
            if len(held) == _ROWS:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class FolderListing(DataSource):
    """``spark.read.format("folder_listing")`` with options ``root``, ``tasks`` and ``suffixes`` (a JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options)


def list_folders(spark: SparkSession, root: str, suffixes: Sequence[str] | None = None, tasks: int = TASKS) -> DataFrame:
    """Files below a folder: (path, file, size, modified, denied), with ``suffixes`` only those with such an extension that are not hidden.

    ``path`` is relative to the folder. A folder that refuses to be listed is a
    row with ``denied`` and neither size nor time. Names that begin with an
    underscore are seen like others; links to folders are not followed. Each
    task lists one subtree; the plan lists at most ``tasks`` folders. The folder
    must be on a file system that pyarrow opens (local or mounted, HDFS, S3,
    GCS); for others there is ``files.scan_corpus``.
    """
    spark.dataSource.register(FolderListing)
    read = spark.read.format("folder_listing").option("root", root).option("tasks", tasks)
    return (read if suffixes is None else read.option("suffixes", json.dumps(list(suffixes)))).load()


def scan_folders(spark: SparkSession, root: str, suffixes: Sequence[str] = SUFFIXES, tasks: int = TASKS) -> DataFrame:
    """``files.scan_corpus`` without content that also sees names beginning with an underscore: (path, file, size, modified, suffix)."""
    return wanted_files(list_folders(spark, root, suffixes, tasks).where(~F.col("denied")).drop("denied"), suffixes)
