"""Token counts as rollups kept up to date by signed deltas.

A delta is a document's count under a tokenizer version with a sign: an insert adds, a delete
takes away, a revision takes the old count away and adds the new one. A batch of deltas is summed
by source, language and tokenizer version and stored under its batch id, once: a folder with its
success mark is a commit, a commit that is there already is left as it is, and one that broke off
is written anew. Totals are the sums over all commits, so the order of batches is of no account,
and repeating one changes nothing.

Defined cases: null texts count no tokens; null sources and languages are groups of their own;
groups whose documents were all deleted leave the totals; an empty batch is a commit without rows;
repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, prepare, text_slices

KEYS = ("source", "lang", "tokenizer")
COUNTS = "doc_id long, source string, lang string, n_tokens long"
LEDGER = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, vocab: str, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, tokenizer: whole texts' numbers of tokens."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in text_slices(batch):
                part = batch.slice(i, j - i)
                n = encoder(vocab).encode_column(part.column(3))[1]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n.astype("int64"))], ["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return rows.mapInArrow(run, COUNTS).withColumn("tokenizer", F.lit(tokenizer))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas from counts that are in force to those that replace them."""
    return deletes(old).unionByName(inserts(new))


class TokenRollup:
    """A ledger of committed batches below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _commits(self) -> list[str]:
        """Folders of all batches that ended; one that broke off has no success mark and isn't counted."""
        if not self._exists(self.path):
            return []
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
        return sorted(p for p in (s.getPath().toString() for s in found if s.isDirectory()) if self._exists(f"{p}/_SUCCESS"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas; False if it is in the ledger already."""
        path = f"{self.path}/batch={batch}"
        if self._exists(f"{path}/_SUCCESS"):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        sums.write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all commits."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.schema(LEDGER).parquet(*commits)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def rollup(self) -> DataFrame:
        """The totals with subtotals of all combinations of keys; ``level`` tells which keys are summed."""
        return self.totals().cube(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().cast("int").alias("level"))
