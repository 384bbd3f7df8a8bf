"""Exact deduplication by a stateful stream: keyed state on disk, never expired.

Each text's digest and length is a key. Structured Streaming keeps, in a RocksDB state store
whose files go to the shared checkpoint, for each key the stable identifier of the row that
stays (largest doc_id), the locator of its content (doc_id and the tag of the staged row) and
the number of rows. No watermark is set, so no key ever expires; a later run with the same
checkpoint continues from the state. The groups are read from the state store itself.

On a hit (a key with more than one row) full bytes are compared: the content at the locator
meets each other row of its key. Large groups are salted, the located content being copied to
each salt, so no group meets in one task. Rows whose bytes differ in spite of equal digests
are grouped anew by their whole text.

All of it is DataFrame and streaming operators; no Python runs on executors.

Defined cases: a null text equals an empty one; of rows with equal doc_id and equal text
exactly one stays (ties go to the larger row tag); a null doc_id loses against any other; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: A key is hot from this part of all rows on, so at most 1/HOT_PART keys are (they are broadcast).
HOT_PART = 0.001
#: Rows of a group that one salt takes.
SALT_ROWS = 4096
#: Keys of groups that may be broadcast (about 80 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 50_000
#: Bytes of staged rows (about 60 each) that one micro-batch reads.
TRIGGER_BYTES = str(1 << 30)

#: State on disk, its memory bounded for each executor; no preallocated files, as there are many stores.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, trigger: dict[str, str] | None = None) -> None:
    """Run the stream over all staged rows below ``source`` that the checkpoint hasn't seen.

    State: digest, n_bytes -> rows so far, and the largest (doc_id, row_tag).
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).options(**(trigger or {"maxBytesPerTrigger": TRIGGER_BYTES})).parquet(source)
        state = rows.groupBy("digest", "n_bytes").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row_tag")).alias("stays"))
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """digest, n_bytes, n, keep_id, keep_tag of every key in the state store."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", "key.n_bytes", F.col("value.count").alias("n"), F.col("value.max.doc_id").alias("keep_id"), F.col("value.max.row_tag").alias("keep_tag"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, space: Workspace | None = None, trigger: dict[str, str] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, hash (xxhash64 of the text) for every row."""
    spark = docs.sparkSession
    space = space or Workspace(spark, "exact")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A null doc_id sorts below all others in max() over structs, so it never wins.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("text").cast("string").alias("original"))
    staged = space.stage(
        keyed.select("doc_id", F.monotonically_increasing_id().alias("row_tag"), digest(F.col("text")).cast("binary").alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), sha256(F.col("text")).alias("sha"), F.xxhash64("original").alias("hash")),
        "staged",
    )
    ingest(spark, f"{space.path}/staged", "doc_id long, row_tag long, digest binary, n_bytes long", f"{space.path}/checkpoint", trigger)
    groups = space.stage(read_state(spark, f"{space.path}/checkpoint"), "groups")
    total = staged.count()
    hot = groups.where(F.col("n") >= F.lit(max(1000, int(total * HOT_PART))))
    key = ["digest", "n_bytes"]
    near, hot_keys = F.broadcast(hot), F.broadcast(hot.select(key))
    found = staged.join(near, key).unionByName(staged.join(hot_keys, key, "left_anti").join(groups.join(hot_keys, key, "left_anti"), key))

    # Hits: rows of groups of two and more, against the bytes at the locator.
    hits = groups.where("n > 1").withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
    hashed = keyed.drop("original").withColumn("digest", digest(F.col("text")).cast("binary")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    if hits.count() <= BROADCAST_KEYS:  # texts of other rows needn't move
        members = hashed.join(F.broadcast(hits), key)
    else:
        hot_hits = F.broadcast(hits.join(hot_keys, key, "left_semi"))
        members = hashed.join(hot_hits, key).unionByName(hashed.join(hot_keys, key, "left_anti").join(hits.join(hot_keys, key, "left_anti"), key))
    members = space.stage(members, "members", compression="zstd")
    located = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest", "n_bytes"])
    located = located.select("digest", "n_bytes", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    compared = members.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")).join(located, [*key, "salt"])
    differ = space.stage(compared.where(F.col("text") != F.col("kept_text")).select(*key).distinct(), "differ")
    out = found
    if not differ.isEmpty():  # equal digests of different texts: their keys are grouped by the text itself
        clash = staged.join(differ, key, "left_semi").select("row_tag", "doc_id", "sha", "hash", *key)
        texts = hashed.join(differ, key, "left_semi")
        whole = texts.groupBy(*key, "text").agg(F.sha2(F.first("text").cast("binary"), 256).alias("hex"))
        whole = whole.select(*key, F.unhex("hex").alias("sha"))  # one row for each different text
        each = clash.join(whole, [*key, "sha"]).groupBy(*key, "sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row_tag")).alias("stays"))
        each = each.select(*key, "sha", "n", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row_tag").alias("keep_tag"))
        out = found.join(differ, key, "left_anti").unionByName(clash.join(each, [*key, "sha"]).select(found.columns))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_tag") == F.col("keep_tag")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "hash")
