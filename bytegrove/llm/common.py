"""What the training-data operators share: staging, worker set-up, words, tokenizers."""

from __future__ import annotations

import atexit
import gc
import json
import os
import tempfile
import time
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Rows of an Arrow batch sent to Python: few, as one text may be megabytes.
BATCH_ROWS = 512
#: Bytes of such a batch, or one row.
BATCH_BYTES = 4 << 20
#: Of Python workers: large arrays go back to the system when they are freed.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package; bound the Arrow batches they get."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """A folder of this run's own below spark.checkpoint.dir.

    Tables written here cut lineage: a lost executor costs a reread, not a recomputation.
    The setting is read from the session; a temporary folder serves only where it is unset
    (local tests). The folder goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="bytegrove-")
        self.path = f"{root.rstrip('/')}/bytegrove-{label}-{uuid.uuid4().hex}"
        atexit.register(self.end)
        self.tables: set[str] = set()

    def stage(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and read it back with the same schema."""
        path = f"{self.path}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage_buckets(self, df: DataFrame, name: str, key: str, **options: str) -> DataFrame:
        """Stage ``df`` in buckets of ``key``, as many as the session has shuffle partitions: joins on
        the key leave these rows where they are."""
        table = self._table(name)
        self.tables.add(table)
        df.write.options(path=f"{self.path}/{name}", **options).format("parquet").bucketBy(n_parts(self.spark), key).saveAsTable(table)
        return self.spark.table(table)

    def _table(self, name: str) -> str:
        return f"{self.path.rsplit('/', 1)[1]}_{name}".replace("-", "_")

    def drop(self, name: str) -> None:
        """Delete a staged table that nothing reads any more."""
        self._forget(self._table(name))
        _delete(self.spark, f"{self.path}/{name}")

    def end(self) -> None:
        """Delete all that was staged."""
        for table in list(self.tables):
            self._forget(table)
        _delete(self.spark, self.path)

    def _forget(self, table: str) -> None:
        """Take a table out of the catalog; its files stay."""
        if table in self.tables:
            self.tables.remove(table)
            try:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            except Exception:  # the session may be gone at exit
                pass

    def sweep(self) -> None:
        """Free shuffle files of finished steps: Spark does so when the JVM collects their handles, which
        Python may hold in cycles."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)  # files go in the background


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is scratch space
        pass


def n_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted(spark: SparkSession, big: DataFrame, small: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join on ``key``; keys listed in ``hot`` (a proven bounded table) go by broadcast.

    No hot key's rows meet in one task: they stay where they are, while the rest are shuffled.
    """
    hot = F.broadcast(hot.select(key))
    near = big.join(hot, key, "left_semi").join(F.broadcast(small.join(hot, key, "left_semi")), key, "left")
    far = big.join(hot, key, "left_anti").join(small.join(hot, key, "left_anti"), key, "left")
    return near.unionByName(far)


# --- words ------------------------------------------------------------------------------

#: ASCII white space to the space, A-Z to a-z, for single bytes.
_PLAIN_BYTES = np.arange(256, dtype="u1")
_PLAIN_BYTES[9:14] = 32
_PLAIN_BYTES[65:91] += 32


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in a row, and where each text starts (and the last one ends)."""
    texts = pa.array(texts.fill_null(""), pa.large_string()) if not pa.types.is_large_string(texts.type) else texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "<i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    raw = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return raw[at[0] : at[-1]], at - at[0]


def distinct_parts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Parts of ``data`` from each start to the next, as numbers in a list of the distinct ones."""
    offsets = np.append(starts, len(data)).astype("<i4")
    parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    _, offsets, raw = parts.dictionary.buffers()
    cut = np.frombuffer(offsets, "<i4")[: len(parts.dictionary) + 1].tolist()
    raw = raw.to_pybytes() if raw is not None else b""
    return parts.indices.to_numpy(), [raw[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]  # to_pylist() is slow


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words (runs of anything but ASCII white space, A-Z lower-cased) of a text column.

    Each word as a number, the distinct words, and how many each text has. Arrow and numpy do this
    for all texts at once; only distinct words become Python objects.
    """
    raw, at = joined(texts)
    data = _PLAIN_BYTES[raw]
    inside = data != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    starts[first] = inside[first]
    before = np.concatenate([[0], np.cumsum(starts)])
    codes, words = distinct_parts(data[inside], np.flatnonzero(starts[inside]))
    return codes, words, np.diff(before[at])


# --- tokenizers -------------------------------------------------------------------------

#: Distinct words whose ids a worker keeps; past it the cache starts afresh.
CACHE_WORDS = 1_000_000
#: Longer chunks are encoded but not kept.
CACHE_BYTES = 48
#: Of each byte of UTF-8 text: 0 white space between chunks, 1 letter, 2 digit, 3 other, 4 not plain.
#: Plain are printable ASCII but the apostrophe, which starts patterns of its own, and precomposed
#: Latin letters but those of _ODD. A run of letters is a word, a digit is, and a run of others.
KINDS = np.array([0 if c in (10, 32) else 4 if c < 33 or c in (39, 127) or not (c < 128 or 0x80 <= c <= 0xBF or 0xC3 <= c <= 0xC5) else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], "u1")
#: Pairs of bytes that aren't plain: the multiplication and division signs, a letter whose lower case
#: is two characters, the long s, and the start of special tokens.
_ODD = (0xC397, 0xC3B7, 0xC4B0, 0xC5BF, 0x3C7C)
#: What is known to hold for white space between chunks and for words, by the parts of a tokenizer's file.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_ENCODERS: dict[str, ChunkEncoder] = {}


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies; a space stays here."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out = np.empty(256, "<u4")
    rest = iter(range(256, 512))
    for byte in range(256):
        out[byte] = byte if byte in shown else next(rest)
    out[32] = 32
    return out


class ChunkEncoder:
    """Whole texts to ids by the tokenizers library, remembering words.

    The word vocabulary drops white space before it forms words, and none of its patterns spans
    a space or line feed, so a text's ids are its words' ids in a row. All texts are cut into words
    in numpy at once, distinct words are found by Arrow, and those not known yet go to the library's
    model, many at a time, with spaces between them; the word-end mark of a word's last id
    tells them apart. Chunks between spaces that aren't plain are words of their own here and encoded
    one by one. Other vocabularies (not of ``_WORDWISE``) get whole texts. Tests hold this against
    encoding whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(Path(path).read_text())
        end = parts["model"].get("end_of_word_suffix")
        self.wordwise = bool(end) and all(parts.get(k) == v for k, v in _WORDWISE.items()) and all(t["special"] and t["content"].startswith("<|") for t in parts["added_tokens"])
        if not self.wordwise:
            return
        self.words = Tokenizer(self.tokenizer.model)  # normalised words in, ids out
        self.words.pre_tokenizer = WhitespaceSplit()
        self.characters = byte_characters()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(end)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.cuts, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, "int64"), 0

    def _one(self, chunk: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in a row, and how many each has."""
        text = " ".join(words_ := b"\n".join(words).decode().lower().split("\n")).encode()
        ready = self.characters[np.frombuffer(text, "u1")].tobytes().decode("utf-32-le")
        ids = np.array(self.words.encode_batch_fast([ready], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) == len(words) and ends[-1] == len(ids) - 1:
            return ids, np.diff(ends, prepend=-1)
        each = [self._one(w) for w in words_]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember words."""
        n, at = len(self.known), self.used
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 1 > len(self.cuts):
            self.cuts = np.concatenate([self.cuts, np.zeros_like(self.cuts)])
        self.ids[at : at + len(ids)] = ids
        self.cuts[n + 1 : n + 1 + len(words)] = at + np.cumsum(sizes)
        self.used = at + len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each followed by ``end``, and how many each text has."""
        if not self.wordwise:
            each = [[*e.ids, *([] if end is None else [end])] for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *(np.array(e, "<u4") for e in each)]), np.array([len(e) for e in each], "int64")
        raw, at = joined(texts)
        kind = KINDS[raw]
        inside = kind > 0
        # Chunks: between white space, and where a text starts.
        chunk = inside.copy()
        chunk[1:] &= ~inside[:-1]
        first = at[:-1][at[:-1] < len(raw)]
        chunk[first] = inside[first]
        starts = chunk.copy()
        starts[1:] |= inside[1:] & ((kind[1:] == 2) | (kind[1:] != kind[:-1]))
        data = _PLAIN_BYTES[raw]
        strange = kind == 4
        pairs = raw[:-1].astype("u2") << 8 | raw[1:]
        for odd in _ODD:
            strange[:-1] |= pairs == odd
        special = np.zeros(0, "int64")
        if strange.any():
            heads = np.flatnonzero(chunk)
            of = np.cumsum(chunk) - 1  # the chunk of each byte
            special = np.unique(of[strange & inside])
            mine = np.isin(of, special) & inside
            data[mine] = raw[mine]
            starts[mine] = False
            starts[heads[special]] = True
            special = np.cumsum(starts)[heads[special]] - 1  # as words
        before = np.concatenate([[0], np.cumsum(starts)])
        codes, words = distinct_parts(data[inside], np.flatnonzero(starts[inside]))
        places = self._places(words, np.unique(codes[special]))
        words_of = np.diff(before[at])
        a = self.cuts[places][codes]
        n = self.cuts[places + 1][codes] - a
        # Each word's ids, one after the other; ends are put between texts.
        gone = np.cumsum(n) - n
        total = int(n.sum())
        ids = self.ids[np.repeat(a - gone, n) + np.arange(total)]
        sizes = np.diff(np.concatenate([gone, [total]])[np.concatenate([[0], np.cumsum(words_of)])])
        if len(self.known) > CACHE_WORDS:
            self._forget()
        if end is not None:
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end))
            sizes = sizes + 1
        return ids, sizes

    def _places(self, words: list[bytes], special: np.ndarray) -> np.ndarray:
        """Where each word is remembered; new ones are encoded."""
        found = list(map(self.known.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        odd = set(special.tolist())
        plain = [words[k] for k in new if k not in odd]
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            self._add(part, *self._learn(part))
        strange = [words[k] for k in new if k in odd]
        if strange:
            each = [self._one(w.decode()) for w in strange]
            self._add(strange, np.concatenate(each), np.array([len(x) for x in each]))
        places = np.fromiter(map(self.known.__getitem__, words), "int64", len(words)) if new else np.array(found, "int64")
        for w in strange:
            if len(w) > CACHE_BYTES:  # its ids stay until the cache starts afresh, but not its bytes
                self.known[b"\n%d" % self.known.pop(w)] = 0
        return places

    def encode(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, then ``end``."""
        ids, sizes = self.encode_column(pa.array(texts, pa.large_string()))
        raw, cut = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:z] + end for a, z in zip([0, *cut[:-1]], cut, strict=True)]


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def text_slices(batch: pa.RecordBatch, max_bytes: int = 4 << 20):
    """Row ranges of a batch whose texts (last column) hold about ``max_bytes`` at most, or one row."""
    held = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False), dtype="int64")
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(held, (held[start - 1] if start else 0) + max_bytes, side="right"))
        end = max(end, start + 1)
        yield start, end
        start = end


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those rejected by ``decisions`` (doc_id, hash of the text, kept).

    Rows that repeat a doc_id and text share a key; where some of them stay and some go, one stays.
    """
    # The row travels as one struct, so no name of its own can clash.
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), whole)

    def matching(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("d"), F.col("hash").alias("h"))
        return rows.join(keys, rows["doc"].eqNullSafe(keys["d"]) & (rows["text_hash"] == keys["h"]), how)

    gone = decisions.where(~F.col("kept")).select("doc_id", "hash")
    out = matching(gone, "left_anti")
    twins = decisions.groupBy("doc_id", "hash").agg(F.min("kept").alias("lo"), F.max("kept").alias("hi")).where("hi and not lo")
    if not twins.isEmpty():
        out = out.unionByName(matching(twins, "left_semi").dropDuplicates(["doc", "text_hash"]))
    return out.select("row.*")
