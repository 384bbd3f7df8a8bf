"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the words of all
documents by weight; a target stops at MAX_EPOCHS times its source's words, and the excess is
shared anew by weight until none is above (water filling, solved exactly).

Each source's documents are dealt by hash into blocks. Whole epochs take every block once; the
rest of a target takes blocks in permuted order as far as each fits; the first LAST_BLOCKS of the others
are taken in part, document by document in permuted order as far as each fits what is left. The
blocks so taken are the source's exact quota. A binary tree splits the quotas of all sources among the output shards: a node
draws the left half's block counts from the multivariate hypergeometric distribution. A shard
gets disjoint runs of each source's permuted blocks and is shuffled locally by a keyed hash.

Only tables with a row for each source, or each source and shard, reach the driver. A source's
planning group has MAX_BLOCKS blocks at most however large the source is; its documents are
spread over its blocks, so no source meets in one task.

Defined cases: a null text has no words; a null source is a source of its own; sources without
words have target 0; rows that repeat a doc_id in one source are taken together; an empty table
gives no rows; the same seed gives the same mix; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Workspace, prepare

#: By a source's rank, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Documents of a block, as planned, and blocks of a source at most.
BLOCK_DOCS, MAX_BLOCKS = 8, 4096
#: Blocks that share what whole blocks leave of a target.
LAST_BLOCKS = 8
#: Shards of the output (a power of two).
SHARDS = 64
SEED = 20240607
#: Rows of a small table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


@dataclass
class Mix:
    """``sized``: doc_id, src, size of every row; ``sources``: src, source_size, target;
    ``taken``: src, doc_id, epoch, shard, mix_key, one row for each time a document is taken."""

    sized: DataFrame
    sources: DataFrame
    taken: DataFrame
    n_sources: int


def source_key() -> Column:
    """A key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], cap: float = MAX_EPOCHS) -> list[float]:
    """Words for each source: a common level times its weight, no more than cap times its size."""
    total, n = float(sum(sizes)), len(sizes)
    order = sorted(range(n), key=lambda i: cap * sizes[i] / weights[i])
    out, left, weight = [0.0] * n, total, float(sum(weights))
    for i in order:
        share = left * weights[i] / weight if weight else 0.0
        out[i] = float(min(cap * sizes[i], share))
        left, weight = left - out[i], weight - weights[i]
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block counts by shard and source; columns add up to ``quotas``."""
    if shards == 1:
        return quotas[None, :]
    left_shards = shards // 2
    left = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * left_shards // shards, method="marginals")
    return np.concatenate([split_tree(left, left_shards, rng), split_tree(quotas - left, shards - left_shards, rng)])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, space: Workspace | None = None) -> Mix:
    """Plan which documents each shard of the mix takes, and how often."""
    spark = docs.sparkSession
    prepare(spark)
    space = space or Workspace(spark, "mixing")
    sized = space.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("src"), n_words(F.col("text")).alias("size")), "sized")
    found = sorted(sized.groupBy("src").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect())
    sizes = [r["size"] for r in found]
    target = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    plan = [(r["src"], r["size"], t, max(1, min(MAX_BLOCKS, r["docs"] // BLOCK_DOCS))) for r, t in zip(found, target, strict=True)]
    sources = spark.createDataFrame(plan, "src string, source_size long, target double, blocks int")

    # A document's block follows from its id alone, so rows that repeat an id stay together.
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")).cast("int")
    units = sized.groupBy("src", "doc_id").agg(F.sum("size").alias("size")).join(_small(sources, len(plan)), "src")
    units = units.select("src", "doc_id", "size", block.alias("block"))
    blocks = space.stage(units.groupBy("src", "block").agg(F.sum("size").alias("words")).join(_small(sources, len(plan)), "src"), "blocks")

    def instances(pdf: pd.DataFrame) -> pd.DataFrame:
        """One source's blocks as often as they are taken, in permuted order, epoch by epoch."""
        pdf = pdf.sort_values("block", ignore_index=True)
        size, goal = int(pdf["source_size"][0]), float(pdf["target"][0])
        full = int(goal // size) if size else 0
        rng = np.random.default_rng([seed, size, len(pdf)])
        out = []
        for epoch in range(full + 1):
            order = rng.permutation(len(pdf))
            words = pdf["words"].to_numpy()[order]
            if epoch == full:
                rest = goal - full * size
                fits = np.zeros(len(order), bool)
                for i, n in enumerate(words.tolist()):  # whole blocks, past those that don't fit
                    if n <= rest:
                        fits[i] = True
                        rest -= n
                last = np.flatnonzero(~fits)[:LAST_BLOCKS]
                chosen = fits.copy()
                chosen[last] = True
                budget, order = np.where(fits, np.nan, rest)[chosen], order[chosen]
            else:
                budget = np.full(len(order), np.nan)
            out.append(pd.DataFrame({"src": pdf["src"][0], "block": pdf["block"].to_numpy()[order], "epoch": epoch, "budget": budget}))
        got = pd.concat(out, ignore_index=True)
        got["ordinal"] = np.arange(len(got))
        got["budget"] = got["budget"].astype(object).where(got["budget"].notna(), None)
        return got

    taken_blocks = space.stage(blocks.groupBy("src").applyInPandas(instances, "src string, block int, epoch int, budget double, ordinal long"), "instances")
    quota = {r["src"]: r["n"] for r in taken_blocks.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = [p[0] for p in plan]
    tree = split_tree(np.array([quota.get(s, 0) for s in names], "int64"), shards, np.random.default_rng(seed)) if names else np.zeros((shards, 0), "int64")
    ends = np.cumsum(tree, axis=0)
    rows = [(s, [int(x) for x in ends[:, i]]) for i, s in enumerate(names)]
    bounds = spark.createDataFrame(rows, T.StructType([T.StructField("src", T.StringType()), T.StructField("ends", T.ArrayType(T.LongType()))]))
    dealt = taken_blocks.join(_small(bounds, len(names) * shards // 8), "src").select("src", "block", "epoch", "budget", F.size(F.filter("ends", lambda e: e <= F.col("ordinal"))).alias("shard"))

    key = F.xxhash64(F.lit(seed + 1), "doc_id", "epoch")
    drawn = units.join(dealt, ["src", "block"]).withColumn("mix_key", key)
    whole = drawn.where(F.col("budget").isNull())

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one source's last blocks, documents in permuted order as far as they fit."""
        pdf = pdf.sort_values(["mix_key", "doc_id"], ignore_index=True)
        left, sizes = float(pdf["budget"][0]), pdf["size"].tolist()
        keep = np.zeros(len(sizes), bool)
        for i, n in enumerate(sizes):
            if n <= left:
                keep[i] = True
                left -= n
        over = [(n, i) for i, n in enumerate(sizes) if not keep[i]]
        if over and min(over)[0] - left < left:  # one more comes nearer
            keep[min(over)[1]] = True
        return pdf[keep]

    part = drawn.where(F.col("budget").isNotNull()).groupBy("src").applyInPandas(fill, drawn.schema)
    taken = whole.unionByName(part).select("src", "doc_id", "epoch", "shard", "mix_key")
    return Mix(sized, sources.drop("blocks"), taken, len(plan))


def mixing_digests(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, and the shards that the tree's leaves took it to (MAX_EPOCHS at most)."""
    often = mixed.taken.groupBy("src", "doc_id").agg(F.count(F.lit(1)).alias("often"), F.array_sort(F.collect_list("shard")).alias("shards"))
    sized, often = mixed.sized.alias("s"), often.alias("o")
    same = (F.col("s.src") == F.col("o.src")) & F.col("s.doc_id").eqNullSafe(F.col("o.doc_id"))
    rows = sized.join(often, same, "left").select("s.src", "s.doc_id", "size", "often", "shards")
    rows = rows.join(_small(mixed.sources, mixed.n_sources), "src")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("often", F.lit(0))).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))


def mixed_documents(docs: DataFrame, mixed: Mix, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, shard by shard in shuffled order."""
    # The row travels as one struct, so no name of its own can clash.
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = docs.select(source_key().alias("row_src"), F.col("doc_id").cast("long").alias("row_doc"), whole)
    taken = mixed.taken.select("src", "doc_id", "shard", "mix_key")
    out = rows.join(taken, (F.col("row_src") == F.col("src")) & F.col("row_doc").eqNullSafe(F.col("doc_id")))
    return out.repartition(shards, "shard").sortWithinPartitions("shard", "mix_key").select("row.*")
