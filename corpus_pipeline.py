"""Documents to packed training sequences: five stages, each written and read again.

Languages are identified and documents of none rejected; of equal texts one document stays, then of
near-duplicates; sources are mixed to their target weights; what the mix takes is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrove.llm import exact_dedup, language_id, mixing, near_dedup, packing
from bytegrove.llm.common import Workspace, keep_rows, prepare, table, vocabulary
from bytegrove.llm.queries import WORD_VOCABULARY


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    found = language_id.identify(language_id.document_evidence(docs), language_id.fit(docs))
    return keep_rows(docs, found.select(F.col("id").alias("doc_id"), "hash", "kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return keep_rows(docs, exact_dedup.exact_groups(docs).select("doc_id", "hash", "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id."""
    return keep_rows(docs, near_dedup.near_classes(docs).select("doc_id", "hash", "kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, sequences and offsets."""
    packed = packing.pack(docs, vocabulary(WORD_VOCABULARY))
    return packed.pieces.join(packed.plan, "piece_id").drop("piece_id")


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenizers and models are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    prepare(spark)
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.stage(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            space.drop(f"stage-{k - 1}")
    return docs
