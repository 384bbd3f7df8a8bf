"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jpeg, katz, language_id, mixing, near_dedup, packing, substring_dedup, token_orc, token_rollup
from .common import Workspace, n_parts, prepare, table, vocabulary

WORD_VOCABULARY = "word_bpe_49k.json"
#: Insert batches of the token rollup.
ROLLUP_BATCHES = 4


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: each document's size, its source's target, and words taken."""
    return mixing.mixing_digests(mixing.mix(table(spark, sf_dir, "documents")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents (doc_id) and all pages (page_id)."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    out = language_id.identify(language_id.document_evidence(docs), model).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "lang", "posterior", "kept")
    pages = language_id.identify(language_id.page_evidence(table(spark, sf_dir, "pages")), model)
    return out.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("page_id"), "lang", "posterior", "kept"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as ORC, read the files back, digest each document."""
    path = f"{Workspace(spark, 'token-orc').path}/ids"
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, vocabulary(WORD_VOCABULARY), n_parts(spark))
    return token_orc.token_digests(token_orc.read_token_orc(spark, path))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents; where each piece lies."""
    return packing.packing_digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model learnt from six sevenths of them."""
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as JPEG media, read back, with dimensions and thumbnail hashes."""
    media = Workspace(spark, "media").stage(jpeg.media_column(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return jpeg.media_features(media)


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents, batch by batch: drafts without counts, which are revised; a batch
    that is deleted and comes back; and a repeated commit, which changes nothing."""
    space = Workspace(spark, "rollup")
    counts = space.stage(token_rollup.count_tokens(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), f"{WORD_VOCABULARY}@1"), "counts")
    ledger = token_rollup.TokenRollup(spark, f"{space.path}/ledger")
    for k in range(ROLLUP_BATCHES):
        batch = counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(ROLLUP_BATCHES)) == k)
        draft = batch.withColumn("n_tokens", F.lit(0).cast("long")).withColumn("tokenizer", F.lit(f"{WORD_VOCABULARY}@0"))
        ledger.commit(f"draft-{k}", token_rollup.inserts(draft))
        ledger.commit(f"revised-{k}", token_rollup.revisions(draft, batch))
        if not k:
            ledger.commit("gone-0", token_rollup.deletes(batch))
            ledger.commit("back-0", token_rollup.inserts(batch))
            ledger.commit("back-0", token_rollup.inserts(batch))
    return ledger.rollup()


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "group_size", "kept")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("hash")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across all documents."""
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def made(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    found = (op1_mixing, op2_language_id, op3_token_orc, op4_best_fit_packing, op5_katz, op6_jpeg, op7_token_rollup, op8_near_dedup, op9_exact_dedup, op10_substring_dedup)
    return {f.__name__: made(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_exact_dedup": """
            select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
                   doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window w as (partition by coalesce(text, ''))""",
    }
