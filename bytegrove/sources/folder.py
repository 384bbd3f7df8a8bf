"""Folder trees as a data source.

Entries come in byte order of their names. Links to files are followed, links to folders and broken
links are left out, as is what can't be read as an entry; an unreadable file stays, without bytes.
Listing reads no file; files are read where the tasks run.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import path_columns

SCHEMA = "scan_id long, order_key array<int>, depth int, path string, path_raw binary, size long, content binary, pinned_type string, is_folder boolean"
#: Entries of one read task, at most.
TASK_ENTRIES = 256

Listed = tuple[list[int], int, bytes, int, bool]  # key, depth, path, size, folder


def walk(path: str | bytes | os.PathLike, recursive: bool, key: list[int] | None = None, depth: int = 1) -> Iterator[Listed]:
    """The entries below a folder, depth first."""
    top = os.fsencode(path)
    try:
        names = sorted(os.listdir(top))
    except OSError:
        return
    at = 0
    for name in names:
        full = os.path.join(top, name)
        try:
            link = stat.S_ISLNK(os.lstat(full).st_mode)
            info = os.stat(full)
        except OSError:
            continue
        folder = stat.S_ISDIR(info.st_mode)
        if folder and (link or not recursive):
            continue
        mine = [*(key or []), 0, 0, at]
        at += 1
        yield mine, depth + 1, full, 0 if folder else info.st_size, folder
        if folder:
            yield from walk(full, recursive, mine, depth + 1)


class _Part(InputPartition):
    def __init__(self, entries: list[Listed]):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.pinned = options.get("pinned_type") or None
        self.content = options.get("content", "true").lower() == "true"
        self.scan_id = int(options.get("scan_id", "0"))

    def partitions(self) -> list[InputPartition]:
        found = [([], 1, os.fsencode(self.path), 0, True), *walk(self.path, self.recursive)]
        return [_Part(found[i : i + TASK_ENTRIES]) for i in range(0, len(found), TASK_ENTRIES)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for key, depth, full, size, folder in partition.entries:
            data = None
            if self.content and not folder:
                try:
                    with open(full, "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
            shown, raw = path_columns(full)
            yield self.scan_id, key, depth, shown, raw, size, data, self.pinned if folder else None, folder


class FolderSource(DataSource):
    """Options: path, recursive (true), content (true), pinned_type of folders, scan_id (0)."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def folder(spark: SparkSession, path: str | os.PathLike, type: str, recursive: bool = True, content: bool = True, scan_id: int = 0) -> DataFrame:
    """A folder and what lies below it, as rows that Scanner.scan() takes as a walked tree."""
    spark.dataSource.register(FolderSource)
    reader = spark.read.format(FolderSource.name())
    options = {"path": os.fspath(path), "recursive": str(recursive), "content": str(content), "pinned_type": type, "scan_id": str(scan_id)}
    return reader.options(**options).load().select("*")


def without_content(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", F.lit(None).cast("binary"))
