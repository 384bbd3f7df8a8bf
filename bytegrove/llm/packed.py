"""Blocks of documents as packed columns, and tables partitioned by key that blocks ask.

A block holds whole documents: a word list by hash and token places in it, one row of a staged
table. Where blocks need values gathered over all documents, each sends its distinct keys, packed
and sorted, to the keys' partitions (one message for each partition that it needs) and gets the
answers in the order of its keys. A key costs one entry for each block, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, split_words

#: Tokens of a block, as planned: bytes of text for each, and for each document besides, so that empty
#: documents fill blocks, too.
BLOCK_TOKENS, TOKEN_BYTES, DOC_BYTES = 1_000_000, 6, 12


# --- packed columns ---------------------------------------------------------------------


def _squeeze(planes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(planes.T.tobytes())


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers: differences, byte plane by byte plane, compressed."""
    d = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return _squeeze(d.view("u1").reshape(-1, 8)) if len(d) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, "u8")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype="u8")


def pack(a: np.ndarray) -> bytes:
    """Numbers of one type, byte plane by byte plane, compressed."""
    return _squeeze(np.ascontiguousarray(a).view("u1").reshape(-1, a.dtype.itemsize)) if len(a) else b""


def unpack(b: bytes, kind: str) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, for dealing keys to partitions."""
    x = x.astype("u8")
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def deal(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(keys) >> np.uint64(33)).astype("int64") % parts


# --- blocks -----------------------------------------------------------------------------

#: One row for each block: documents, their numbers of tokens, the words' hashes in ascending
#: order, and the tokens as places in that list.
BLOCKS = "block long, docs binary, lengths binary, words binary, tokens binary"
NO_DOC = -(1 << 63)


def blocks(docs: DataFrame, hashed: Callable[[list[bytes]], np.ndarray], end: bytes | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of whole documents (doc_id, text); one longer than a block is alone in it.

    Words are cut as by split_words and told apart by ``hashed``; ``end`` follows each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        texts: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, held
            codes, words, counts = split_words(pa.concat_arrays(texts))
            if end is not None:
                at = np.cumsum(counts)
                codes, counts = np.insert(codes, at, len(words)), counts + 1
                words.append(end)
            hashes, place = np.unique(hashed(words), return_inverse=True)
            docs_ = np.concatenate(ids)
            row = (block, docs_.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), pack_sorted(hashes), pack(place.astype("<u4")[codes]))
            block += 1
            ids.clear()
            texts.clear()
            held = 0
            types = (pa.int64(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["block", "docs", "lengths", "words", "tokens"])

        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False) + DOC_BYTES
            numbers = batch.column(0).fill_null(NO_DOC).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > TOKEN_BYTES * block_tokens:
                    if i > start:
                        ids.append(numbers[start:i])
                        texts.append(batch.column(1).slice(start, i - start))
                    start = i
                    yield flush()
                held += n
            ids.append(numbers[start:])
            texts.append(batch.column(1).slice(start))
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCKS)


@dataclass
class Block:
    docs: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        return cls(np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lengths"], "<i8"), unpack_sorted(row["words"]), unpack(row["tokens"], "<u4"))


def doc_array(ids: np.ndarray) -> pa.Array:
    """doc_ids of a block as a column."""
    return pa.array(ids, mask=ids == NO_DOC)


# --- partitioned tables -----------------------------------------------------------------

#: A block's question to one partition of a table: ascending keys, and its share of their values.
ASKED = "part int, block long, keys binary, adds binary"
#: The answer: totals in the order of the keys.
ANSWER = "block long, part int, found binary"


def ask(rows: DataFrame, questions, schema: str = ASKED) -> DataFrame:
    """``questions(row) -> (keys ascending, values)`` for each block, dealt to partitions."""
    wanted, parts = questions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, adds = wanted(row)
                to = deal(keys, parts)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(parts + 1))
                out = []
                for p in range(parts):
                    mine = order[cut[p] : cut[p + 1]]
                    if len(mine):
                        out.append((p, row["block"], pack_sorted(keys[mine]), pack(adds[mine])))
                if out:
                    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "block", "keys", "adds"])

    return rows.mapInArrow(run, schema)


def totals(pdf: pd.DataFrame, kind: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of one partition: each message's places among all keys; the keys; their totals; the place
    (message, position) of each key's first message with a positive share, as a flat index."""
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    adds = np.concatenate([unpack(a, kind) for a in pdf["adds"]])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    which = np.cumsum(new) - 1
    place = np.empty(len(flat), "int64")
    place[order] = which
    total = np.bincount(place, adds.astype("float64"), minlength=int(which[-1]) + 1)
    has = np.where(adds > 0)[0]
    first = np.full(len(total), -1, "int64")
    first[place[has[::-1]]] = has[::-1]
    cuts = np.cumsum([0, *map(len, keys)])
    return [place[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)], ranked[new], total, first


def gather(keys: np.ndarray, parts: int, answers: list[dict], kind: str) -> np.ndarray:
    """A block's answers in the order of its keys."""
    to = deal(keys, parts)
    order = np.argsort(to, kind="stable")
    got = {a["part"]: a["found"] for a in answers or ()}
    return np.concatenate([np.zeros(0, kind), *(unpack(got[p], kind) for p in sorted(got))])[np.argsort(order, kind="stable")]


def answer(space: Workspace, questions: DataFrame, fold, schema: str, name: str, parts: int) -> DataFrame:
    """Fold each partition's questions into answers, staged below ``name``."""
    got = space.stage(questions.repartition(parts, "part").groupBy("part").applyInPandas(fold, schema), name, compression="none")
    space.sweep()
    return got


def with_answers(rows: DataFrame, answered: DataFrame, name: str = "answers") -> DataFrame:
    """Block rows with their answers, those without any included."""
    each = answered.groupBy("block").agg(F.collect_list(F.struct("part", "found")).alias(name))
    return rows.join(each, "block", "left")
