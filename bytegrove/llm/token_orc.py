"""Token ids in ORC: sorted stripes, integer run-length encoding, row indexes, Bloom filters.

Files hold documents in ascending doc_id order (nulls first, repeated ids by text), one range
of ids each. ORC run-length-encodes the integer columns, keeps minima and maxima for each
stripe and row group, and a Bloom filter on doc_id, so a reader splits files by stripe and
skips what a doc_id predicate rules out.

Defined cases: a null text counts as empty and still has the end id; an empty table gives
files without rows; repeated rows are kept, each with its own place; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, prepare, text_slices

#: Id that ends each document.
END_ID = 2
#: Of an ORC stripe, in bytes, and of a row group of its index, in rows.
STRIPE_BYTES, INDEX_ROWS = 16 << 20, 1000
BLOOM_FPP = 0.01

SCHEMA = "doc_id long, shard int, place long, n_tokens long, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, vocab: str, shards: int, end_id: int = END_ID) -> None:
    """Encode whole texts and write them as ORC below ``path`` in ascending doc_id order."""
    prepare(docs.sparkSession)
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j in text_slices(batch):
                part = batch.slice(i, j - i)
                flat, n = encoder(vocab).encode_column(part.column(1), end_id)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(flat.view("<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(n), shard, "int32")), pa.array(place + ends - n), pa.array(n), ids], ["doc_id", "shard", "place", "n_tokens", "ids"])
                place += int(ends[-1])

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(max(1, shards), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, SCHEMA)
        .write.option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; predicates on doc_id prune stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def token_digests(stored: DataFrame) -> DataFrame:
    """For each stored document its start among all ids, its length and the CRC of its ids.

    A file's rows know their place in it; the place of a file follows from the totals of the
    files before it, one small row each.
    """
    prepare(stored.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            offsets = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype("int64")), pa.array(np.array(crc, "int64"))], ["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    rows = stored.select("doc_id", "shard", "place", "ids").mapInArrow(digest, "doc_id long, shard int, place long, n_tokens long, ids_crc32 long")
    total = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
