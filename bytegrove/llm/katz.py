"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Tokens are words (A-Z lower-cased) and one end token a document; a document's first word follows
the end token. Bigram counts r <= GT_MAX are discounted by Good-Turing, as are single counts; what
discounting frees goes to the next lower order, in the end to one unknown word. Backoff weights
divide the freed mass by exactly the lower-order mass of the words not seen after the context, so
every context's probabilities add up to one. A context all of whose counts are above GT_MAX frees
nothing; its own count is raised by one instead. A token is evaluated recursively: its bigram if seen,
else weight times its unigram, else weight times the unknown word's share.

How it is spread. Documents become blocks of at most BLOCK_TOKENS tokens: a word list and token
numbers, staged once. Counts live in tables partitioned by key; a block asks for what its own
tokens need: it sends its sorted distinct keys with its training counts to the keys' partitions,
as one packed message for each partition, and gets totals back in the same order. Three such
rounds serve words, bigrams, and contexts. Counting and lookup are one shuffle, a frequent word
or pair costs one entry for each block, and nothing but a few sums and the counts of counts
reaches the driver. Blocks are staged in buckets, so only answers are shuffled to meet them.

Defined cases: a null text counts as empty (its end token alone is scored); an empty table gives
no rows; an empty training set gives every token the unknown word's probability of 1; repeated
rows are separate documents; a document longer than a block is a block of its own; other columns
are ignored. Words are told apart by 64-bit hashes; pairs by the numbers of both words, under 2^32
known words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, prepare
from .packed import ANSWER, BLOCK_TOKENS, NO_DOC, Block, answer, ask, blocks, deal, doc_array, gather, pack, pack_sorted, totals, unpack, unpack_sorted, with_answers

#: Counts up to this are discounted.
GT_MAX = 5
#: Keys of one partition of a table, as planned from the number of tokens.
PARTITION_KEYS = 1_500_000
#: Held-out documents have crc32(doc_id as text) mod FOLDS equal to FOLD.
FOLDS, FOLD = 7, 2
#: Freed mass of a context that counts as none.
NOTHING = 1e-9

END = b"\n"  # no word has a line feed

#: A word's number (0: not in training) and count in training, whole numbers of 64 bits both.
NUMBERED = np.dtype([("number", "<u8"), ("count", "<u8")])


# --- blocks -----------------------------------------------------------------------------

WORD_HASH_END = xxhash.xxh3_64_intdigest(END)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def held_out(doc_id: int) -> bool:
    return doc_id != NO_DOC and zlib.crc32(str(doc_id).encode()) % FOLDS == FOLD


def held(ids: np.ndarray) -> np.ndarray:
    return np.array([held_out(d) for d in ids.tolist()], bool)


def training(lengths: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each token whether its document is learnt from."""
    return np.repeat(~held, lengths)


def previous(b: Block, end: int) -> np.ndarray:
    """The token before each one; the end token before a document's first."""
    before = np.concatenate([[end], b.tokens[:-1]]).astype("u4")
    before[np.cumsum(b.lengths)[:-1]] = end
    return before


# --- the model --------------------------------------------------------------------------


def discounts(counts_of_counts: dict[int, int], k: int = GT_MAX) -> np.ndarray:
    """Factor for each count 0..k+1 (the last: all above k). Katz's form of Good-Turing; where the
    counts of counts are too thin for it (a factor outside (0, 1)), absolute discounting by
    n1 / (n1 + 2 n2) takes over for all counts up to k, so mass for backoff is always freed."""
    n = [0.0] + [float(counts_of_counts.get(r, 0)) for r in range(1, k + 2)]
    d = np.ones(k + 2)
    if not n[1]:
        return d * 0.9  # no singletons: a fixed tenth
    common = (k + 1) * n[k + 1] / n[1]
    ok = common < 1 and all(n[r] for r in range(1, k + 2))
    if ok:
        for r in range(1, k + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        ok = bool(np.all((d[1 : k + 1] > 0) & (d[1 : k + 1] < 1)))
    if not ok:
        off = n[1] / (n[1] + 2 * n[2])
        off = min(max(off, 0.05), 0.95)
        d[1 : k + 1] = [1 - off / r for r in range(1, k + 1)]
        d[k + 1] = 1.0
    return d


def by_count(d: np.ndarray, r: np.ndarray) -> np.ndarray:
    return d[np.minimum(r, len(d) - 1).astype("int64")]


@dataclass
class Unigrams:
    """Probabilities of single words from their counts."""

    n: int  # training tokens
    v: int  # distinct training tokens
    d: np.ndarray
    kept: float  # discounted mass of all seen words

    def p(self, c: np.ndarray) -> np.ndarray:
        """Of a seen word its discounted share, of an unseen one the whole unknown mass."""
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, by_count(self.d, c) * c / self.n, 1 - self.kept)


def _stats(answered: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Sum, number and counts of counts of a table's positive totals."""
    row = answered.agg(F.sum("tokens"), F.sum("types"), *[F.sum(F.element_at("counts", r)) for r in range(1, GT_MAX + 2)]).first()
    return int(row[0] or 0), int(row[1] or 0), {r: int(row[1 + r] or 0) for r in range(1, GT_MAX + 2)}


def katz_scores(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, partition_keys: int = PARTITION_KEYS, space: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    spark = docs.sparkSession
    prepare(spark)
    space = space or Workspace(spark, "katz")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    block_rows = space.stage_buckets(blocks(docs, hashes, END, block_tokens), "blocks", "block", compression="none")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a block from here on
    try:
        return _score(space, block_rows, partition_keys)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def _score(space: Workspace, block_rows: DataFrame, partition_keys: int) -> DataFrame:
    size = block_rows.select(F.sum(F.length("lengths")), F.sum(F.length("tokens"))).first()
    stored = int(size[1] or 0)  # bytes of packed tokens, about two for each
    parts = max(2, -(-stored // (2 * partition_keys)))
    word_parts = max(2, -(-parts // 3))

    # Words: counts in training, and a number from 1 for each.
    def words(row: dict) -> tuple[np.ndarray, np.ndarray]:
        b = Block.of(row)
        return b.words, np.bincount(b.tokens[training(b.lengths, held(b.docs))], minlength=len(b.words)).astype("<u4")

    def count(with_number: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            places, _, total, first = totals(pdf, "<u4")
            r = total.astype("int64")
            low = np.bincount(np.minimum(r[r > 0], GT_MAX + 2), minlength=GT_MAX + 2)[1 : GT_MAX + 2].tolist()
            start, out = 0, []
            number = np.cumsum(r > 0) * (r > 0)
            for k, p in enumerate(places):
                mine = first[p] == start + np.arange(len(p))  # this message owns the key
                start += len(p)
                if with_number:
                    found = np.empty(len(p), NUMBERED)
                    found["number"], found["count"] = number[p], r[p]
                else:
                    found = (r[p] << 1 | mine).astype("<u8")
                out.append(pack(found))
            lead = [k == 0 for k in range(len(places))]
            return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "found": out, "tokens": [int(r.sum()) if x else 0 for x in lead], "types": [int((r > 0).sum()) if x else 0 for x in lead], "counts": [low if x else [0] * (GT_MAX + 1) for x in lead]})

        return run

    counted = f"{ANSWER}, tokens long, types long, counts array<long>"

    word_rows = answer(space, ask(block_rows, (words, word_parts)), count(True), counted, "words", word_parts)
    n, v, low = _stats(word_rows)
    d1 = discounts(low)
    # Exact mass of the seen words: every count above GT_MAX keeps its share.
    kept = (n - sum(r * low[r] * (1 - d1[r]) for r in range(1, GT_MAX + 1)) - (1 - d1[GT_MAX + 1]) * (n - sum(r * low[r] for r in range(1, GT_MAX + 1)))) / n if n else 0.0
    uni = Unigrams(n, v, d1, kept)

    def known(row: dict) -> tuple[Block, np.ndarray, np.ndarray]:
        """The block, and for each of its words the number (0: not in training) and count."""
        b = Block.of(row)
        found = gather(b.words, word_parts, row["answers"], NUMBERED)
        number, c = found["number"], found["count"].astype("int64")
        to = deal(b.words, word_parts).astype("u8")
        return b, np.where(number > 0, number * np.uint64(word_parts) + to, 0).astype("u8"), c

    def with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks for the rounds that follow; pairs are formed anew in each, to keep tables small."""
        for batch in batches:
            for row in batch.to_pylist():
                b, number, c = known(row)
                out = {"block": row["block"], "docs": row["docs"], "lengths": row["lengths"], "tokens": row["tokens"], "numbers": pack(number), "counts": pack(c.astype("<u8")), "end": int(np.searchsorted(b.words, np.uint64(WORD_HASH_END)))}
                yield pa.RecordBatch.from_pylist([out], schema=pa.schema([("block", pa.int64()), *[(k, pa.binary()) for k in list(out)[1:-1]], ("end", pa.int64())]))

    numbered = "block long, docs binary, lengths binary, tokens binary, numbers binary, counts binary, `end` long"
    pair_rows = space.stage_buckets(with_answers(block_rows, word_rows).mapInArrow(with_words, numbered), "numbered", "block", compression="none")
    space.sweep()
    space.drop("blocks")
    space.drop("words")

    # Pairs: only those of two known words can be seen; the others aren't asked for.
    def split(row: dict) -> tuple[np.ndarray, ...]:
        """Words' numbers and counts; distinct pairs' words; each token's pair; the keys asked for."""
        number, c = unpack(row["numbers"], "<u8"), unpack(row["counts"], "<u8").astype("i8")
        b = Block(np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lengths"], "<i8"), None, unpack(row["tokens"], "<u4"))
        pair, at = np.unique(previous(b, row["end"]).astype("u8") << np.uint64(32) | b.tokens, return_inverse=True)
        left, right = (pair >> np.uint64(32)).astype("int64"), (pair & np.uint64(0xFFFFFFFF)).astype("int64")
        key = number[left] << np.uint64(32) | number[right]
        wanted = np.where((number[left] > 0) & (number[right] > 0))[0]
        wanted = wanted[np.argsort(key[wanted], kind="stable")]
        return b, at, number, c, left, right, key[wanted], wanted

    def pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
        b, at, _, _, left, _, key, wanted = split(row)
        train = np.bincount(at[training(b.lengths, held(b.docs))], minlength=len(left)).astype("<u4")
        return key, train[wanted]

    seen_rows = answer(space, ask(pair_rows, (pairs, parts)), count(False), counted, "seen", parts)
    _, _, low2 = _stats(seen_rows)
    d2 = discounts(low2)

    def seen(row: dict) -> tuple[np.ndarray, ...]:
        """What split() gives, and each distinct pair's count and whether this block owns it."""
        b, at, number, c, left, right, key, wanted = split(row)
        found = gather(key, parts, row["answers"], "<u8")
        r, own = np.zeros(len(left), "int64"), np.zeros(len(left), bool)
        r[wanted], own[wanted] = found >> np.uint64(1), found & np.uint64(1)
        return b, at, number, c, left, right, r, own

    # Contexts: for each known word the sums over the pairs it begins, from the pairs' owners.
    def contexts(row: dict) -> tuple[np.ndarray, np.ndarray]:
        _, _, number, c, left, right, r, own = seen(row)
        sums = np.zeros((len(number), 2))
        mine = np.where(own)[0]
        for k, value in enumerate((by_count(d2, r[mine]) * r[mine] / np.maximum(c[left[mine]], 1), uni.p(c[right[mine]]))):
            sums[:, k] = np.bincount(left[mine], value, minlength=len(number))
        asks = np.zeros(len(number), bool)
        asks[left] = True
        wanted = np.where(asks & (number > 0))[0]
        wanted = wanted[np.argsort(number[wanted], kind="stable")]
        return number[wanted], np.ascontiguousarray(sums[wanted]).view("<c16").reshape(-1)

    def add_up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in pdf["keys"]]
        values = np.concatenate([unpack(a, "<c16") for a in pdf["adds"]])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        high, low_ = np.bincount(place, values.real), np.bincount(place, values.imag)
        free, rest = 1 - high, np.maximum(1 - low_, 1e-300)
        # Below zero: nothing is freed; the context's count is raised by one, and this is 1 / rest.
        alpha = np.where(free > NOTHING, free, -1.0) / rest
        cuts = np.cumsum([0, *map(len, keys)])
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "found": [pack(alpha[place[a:z]].astype("<f8")) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]})

    joined = with_answers(pair_rows, seen_rows)
    weight_rows = answer(space, ask(joined, (contexts, word_parts)), add_up, ANSWER, "weights", word_parts)
    full = with_answers(with_answers(pair_rows, seen_rows), weight_rows, "weights")
    scale = np.log10(float(n + v + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, at, number, c, left, right, r, _ = seen(row)
                asks = np.zeros(len(number), bool)
                asks[left] = True
                wanted = np.where(asks & (number > 0))[0]
                wanted = wanted[np.argsort(number[wanted], kind="stable")]
                alpha = np.ones(len(number))  # an unknown context leaves the unigram as it is
                alpha[wanted] = gather(number[wanted], word_parts, row["weights"], "<f8")
                raised = alpha < 0
                alpha = np.where(raised, -alpha / (c + 1), alpha)
                logp = np.log10(np.where(r > 0, by_count(d2, r) * r / np.maximum(c + raised, 1)[left], alpha[left] * uni.p(c[right])))
                lengths = b.lengths
                doc = np.repeat(np.arange(len(lengths)), lengths)
                token_c = c[right][at]
                sums = [np.bincount(doc, w, minlength=len(lengths)) for w in (logp[at], np.log10(token_c + 1) - scale, token_c > 0)]
                ids = b.docs
                yield pa.RecordBatch.from_arrays(
                    [doc_array(ids), pa.array(held(ids)), pa.array(lengths), pa.array(sums[2].astype("int64")), pa.array(np.full(len(ids), n)), pa.array(sums[1]), pa.array(sums[0])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return space.stage(full.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
