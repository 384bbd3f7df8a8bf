"""Tables and files as contents: scan_id, path, path_raw, size, content, pinned_type, is_folder."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import path_columns

SCHEMA = "scan_id long, path string, path_raw binary, size long, content binary, pinned_type string, is_folder boolean"


def buffers(spark: SparkSession, items: Iterable[tuple]) -> DataFrame:
    """Contents from (bytes, path) or (bytes, path, pinned type) in memory; scan_id counts them."""
    rows = []
    for k, (data, path, *pinned) in enumerate(items):
        shown, raw = path_columns(path)
        rows.append((k, shown, raw, len(data), bytes(data), pinned[0] if pinned else None, False))
    return spark.createDataFrame(rows, SCHEMA)


def text_table(df: DataFrame, scan_id: Column, path: Column, text: Column, pinned_type: Column | None = None) -> DataFrame:
    """Contents from a text column, as UTF-8 bytes; a null text is unreadable, of size 0."""
    data = F.encode(text, "UTF-8")
    return df.select(
        scan_id.cast("long").alias("scan_id"), path.alias("path"), F.lit(None).cast("binary").alias("path_raw"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"),
        data.alias("content"), (F.lit(None) if pinned_type is None else pinned_type).cast("string").alias("pinned_type"), F.lit(False).alias("is_folder"),
    )


def files(spark: SparkSession, path: str | os.PathLike, pinned_type: str | None = None, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Contents from files that Spark can read; one scan for each file.

    The length comes from the listing, and bytes are read only where a plugin uses them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(os.fspath(path)).select(
        F.xxhash64("path").alias("scan_id"), "path", F.lit(None).cast("binary").alias("path_raw"), F.col("length").alias("size"), "content", F.lit(pinned_type).cast("string").alias("pinned_type"), F.lit(False).alias("is_folder")
    )
