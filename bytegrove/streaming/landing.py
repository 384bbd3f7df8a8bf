"""Scanning files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.scanner import Scanner

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """New files below a folder as streaming contents; each is a scan of its own."""
    rows = spark.readStream.format("binaryFile").schema(BINARY_FILE).load(path)
    return rows.select(F.xxhash64("path").alias("scan_id"), "path", F.col("length").alias("size"), "content")


def scan_arriving(scanner: Scanner, contents: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scan each micro-batch and write its tables below ``out``/batch=N; a batch that is run
    again overwrites its own tables, so results appear once."""

    def one(rows: DataFrame, batch: int) -> None:
        scanner.scan(rows).write(f"{out.rstrip('/')}/batch={batch}")

    writer = contents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
