"""Scratch tables in the folder that the session names for checkpoints, and what Python workers get at once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows, and bytes or one row, of an Arrow batch sent to Python: few, as a content may be megabytes.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches be no larger than BATCH, so a worker's memory doesn't follow its input."""
    number = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in BATCH.items():
        if not 0 < number(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


class Staging:
    """Tables written below spark.checkpoint.dir and read back; lineage ends there.

    A temporary folder serves only where the setting is unset. All goes when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        self.path = f"{(root or tempfile.mkdtemp(prefix='bytegrove-')).rstrip('/')}/scan-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        try:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone; the folder is scratch space
            pass
