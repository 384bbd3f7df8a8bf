"""Near-duplicate classes by BagMinHash, banding and exact verification.

A document is the multiset of its five-word shingles; words are white-space tokens in lower case
without punctuation (in a text of punctuation alone, the tokens themselves). Its weight for a shingle
is the number of times it occurs, discretised to integers. The weight axis is cut hierarchically
into dyadic ranges [0,1), [1,2), [2,4), ...; each shingle and range has a Poisson process whose
rate is the range's width, seeded by both alone. A point has a time, a component and a level in
the range; a document sees the points below its weight. The earliest time of each component is
the signature, and two signatures agree in a component with the weighted Jaccard similarity as
probability. Points come in ascending time, so only the few before a document's bound are made;
where a component stays empty the bound is raised and the document redone.

Bands of ROWS components make buckets. Each bucket's pivot is the member that meets most others in
all its buckets: the text that copies were made from meets them more often than they meet each
other. Each document is first compared, by the exact multiset overlap, with the one pivot it shares
most buckets with, and links are contracted to components.
What then still lies in two or more classes of a bucket is compared in blocks: a bucket is cut
into chunks of CHUNK documents, and a task takes two chunks. It counts agreeing components for
all their pairs of different classes at once, and keeps, as one list for each document, those
that may reach the threshold and whose first common band (by the buckets' own keys) is this bucket's;
another pass takes the texts of these documents and computes the exact overlap, leaving out pairs
that links found so far connect. So every pair of a bucket is either connected or compared; a unit has
at most 2 CHUNK rows and its lists at most CHUNK^2 numbers, and a large group is many tasks. Documents
with the same multiset are one document here, so copies never multiply. A link of similarity 0.8 is
missed with probability (1 - 0.8^4)^32, 5e-8, by bands and 1e-9 by agreement; more similar ones
with less.

Defined cases: texts under five words have their whole word list as one shingle; null, empty and
wordless texts are one class; of rows with the same doc_id one stays; a null doc_id loses against
any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, prepare, salted, split_words, text_slices

WORDS, THRESHOLD = 5, 0.8
#: Signature: BANDS * ROWS components.
BANDS, ROWS = 32, 4
#: Documents of a chunk of a bucket.
CHUNK = 512
#: Pairs whose signatures agree in fewer components than this, six standard deviations below
#: what a pair at the threshold has, are told apart without their texts.
LEAST_AGREEMENT = int(BANDS * ROWS * (THRESHOLD - 6 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5))
#: Expected points for each component beyond its logarithm; more means fewer repeats.
SPARE = 2.5
#: Groups of rows with one multiset that have this part of all rows are joined by broadcast.
HOT_PART = 0.001


#: All but letters, marks, digits and line feeds.
_ELSE = regex.compile(r"[^\p{L}\p{M}\p{N}\n]+")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Of words (none has a line feed) in lower case without punctuation; 0 where nothing is left."""
    if not words:
        return np.zeros(0, "u8")
    plain = _ELSE.sub("", b"\n".join(words).decode().lower()).split("\n")
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, plain), "u8", len(plain))
    out[out == 0] = 1
    out[out == xxhash.xxh3_64_intdigest("")] = 0
    return out


def word_hash(word: bytes) -> int:
    """Of one word."""
    return int(word_hashes([word])[0])


_ALL = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Hashes of the shingles of each text of a column, ascending, with repeats."""
    codes, found, counts = split_words(texts)
    hashes = word_hashes(found)
    h = hashes[codes]
    ends = np.cumsum(counts)
    out = []
    for a, z in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        x = h[a:z]
        if len(x):
            keep = x[x != 0]
            x = keep if len(keep) else np.fromiter((xxhash.xxh3_64_intdigest(found[c]) for c in codes[a:z]), "u8", z - a)
            k = min(words, len(x))
            key = np.zeros(len(x) - k + 1, "u8")
            for i in range(k):
                key = key * np.uint64(0x9E3779B97F4A7C15) + x[i : i + len(key)]
            x = np.sort(mix64(key + np.uint64(k)))
        out.append(x)
    return out


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The shingles of one text."""
    return shingle_sets(pa.array([text], pa.large_string()), words)[0]


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Multiset Jaccard similarity of two ascending arrays; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    start = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(start) - 1
    mine = np.bincount(group, order < len(a))
    total = np.bincount(group)
    common = np.minimum(mine, total - mine).sum()
    return float(common / (len(a) + len(b) - common))


def signatures(docs: list[np.ndarray], m: int = BANDS * ROWS, spare: float = SPARE) -> np.ndarray:
    """BagMinHash signatures of ascending shingle arrays; rows of empty ones are infinite."""
    out = np.full((len(docs), m), np.inf)
    todo = np.array([i for i, d in enumerate(docs) if len(d)], "int64")
    extra = spare
    while len(todo):
        part = [docs[i] for i in todo]
        sizes = np.array([len(d) for d in part])
        bound = m * (np.log(m) + extra) / sizes
        out[todo] = _points(part, sizes, bound, m)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        extra += 2 * spare
    return out


def _points(docs: list[np.ndarray], sizes: np.ndarray, bound: np.ndarray, m: int) -> np.ndarray:
    flat = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), sizes)
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])])
    at = np.where(new)[0]
    weight = np.diff(at, append=len(flat))
    shingle, doc = flat[at], doc[at]
    sig = np.full(len(docs) * m, np.inf)
    low, width = 0, 1
    while len(shingle):
        # One process for each shingle whose weight reaches into [low, low + width).
        state = mix64(shingle + np.uint64((width * 0xD6E8FEB86659FD93 + low) & _ALL))
        d, w, seed, time = doc, weight, state, np.zeros(len(shingle))
        limit = bound[d]
        step = 0
        while len(d):
            step = (step + 0x9E3779B97F4A7C15) & _ALL
            r = mix64(seed + np.uint64(step))
            time = time - np.log1p(-(r >> np.uint64(11)).astype("f8") * 2.0**-53) / width
            live = time <= limit
            d, w, seed, time, limit, r = d[live], w[live], seed[live], time[live], limit[live], r[live]
            r = mix64(r ^ np.uint64(0xA0761D6478BD642F))
            slot = d * m + (r % np.uint64(m)).astype("int64")
            if width == 1:
                np.minimum.at(sig, slot, time)
            else:
                seen = low + ((r >> np.uint64(16)) % np.uint64(width)).astype("int64") < w
                np.minimum.at(sig, slot[seen], time[seen])
        low, width = low + width, max(1, low + width)
        more = weight > low
        shingle, doc, weight = shingle[more], doc[more], weight[more]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band."""
    bits = sig.view("u8").reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype="u8"), bits.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view("i8")


def sketches(sig: np.ndarray) -> np.ndarray:
    """Eight bits of each component, for counting agreements: equal components are never missed."""
    return (mix64(sig.view("u8")) >> np.uint64(56)).astype("u1")


SIGNED = "rid long, doc_id long, hash long, fp binary, sketch binary, bands binary"


def _sign(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j in text_slices(batch, 1 << 20):
                part = batch.slice(i, j - i)
                found = shingle_sets(part.column(2))
                sig = signatures(found)
                keys, sketch = band_keys(sig), sketches(sig)
                n = len(found)
                # Two sums of scrambled hashes and the size identify a multiset.
                fp = [b"%d:" % len(s) + mix64(s ^ np.uint64(0x51)).sum(dtype="u8").tobytes() + mix64(s ^ np.uint64(0xA3)).sum(dtype="u8").tobytes() for s in found]
                bands = [x.tobytes() for x in keys.astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(next_id, next_id + n)), part.column(0), part.column(1), pa.array(fp, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(bands, pa.binary())], ["rid", "doc_id", "hash", "fp", "sketch", "bands"])
                next_id += n

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(run, SIGNED)


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose multisets overlap enough; rows of a pivot b come in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, "u8")
        for batch in batches:
            keep = []
            sets = shingle_sets(batch.column(2))
            for k, (a, b, mine) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True)):
                if b != last:
                    last, known = b, shingles(batch.column(3)[k].as_py())
                few, many = sorted((len(mine), len(known)))
                if few >= threshold * many and overlap(mine, known) >= threshold:
                    keep.append((a, b))
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keep, strict=True)], ["a", "b"])

    left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


#: A document in a task on two chunks of a bucket; ``side`` 0 is the first chunk, 1 the second
#: (a chunk with itself has side 0 alone).
UNIT = ("key", "i", "j")


def _units(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows sorted by unit, a unit at a time."""
    names = ("rid", "label", "side", "band", *extra)
    unit, rows = None, {n: [] for n in names}
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in UNIT), strict=True))
        columns = {n: batch.column(n).to_pylist() for n in names}
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if keys[at] != unit:
                if unit is not None:
                    yield unit, rows
                unit, rows = keys[at], {n: [] for n in names}
            for n in names:
                rows[n] += columns[n][at:end]
            at = end
    if unit is not None:
        yield unit, rows


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a unit that may link to others of it: the list of those with larger
    numbers of rows in the unit, which may be empty for a document that is only in others' lists."""
    for (key, i, j), rows in _units(batches, ("sketch", "bands")):
        sketch = np.frombuffer(b"".join(rows["sketch"]), "u1").reshape(len(rows["rid"]), -1)
        keys = np.frombuffer(b"".join(rows["bands"]), "<i8").reshape(len(rows["rid"]), -1)
        rid, label, side = (np.array(rows[n], "int64") for n in ("rid", "label", "side"))
        left = np.where(side == 0)[0]
        right = np.where(side == 1)[0] if i != j else left
        lists: dict[int, list[int]] = {}
        for a in left.tolist():
            others = right[label[right] != label[a]] if i != j else right[(right > a) & (label[right] != label[a])]
            others = others[(sketch[others] == sketch[a]).sum(axis=1) >= LEAST_AGREEMENT]
            # Pairs that meet in an earlier bucket are compared there.
            others = others[(keys[others] == keys[a]).argmax(axis=1) == rows["band"][a]]
            if len(others):
                lists.setdefault(a, []).extend(rid[others].tolist())
                for b in others.tolist():
                    lists.setdefault(b, [])
        if lists:
            out = [(key, i, j, int(rid[a]), found) for a, found in lists.items()]
            types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*UNIT, "rid", "others"])


def _links(threshold: float):
    """From a unit's documents with texts and lists of others: links between classes, each pair of
    classes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _units(batches, ("text",)):
            place = {r: k for k, r in enumerate(rows["rid"])}
            found: dict[int, np.ndarray] = {}
            parent = {x: x for x in rows["label"]}

            def root(x: int) -> int:
                while parent[x] != x:  # noqa: B023
                    parent[x] = parent[parent[x]]  # noqa: B023
                    x = parent[x]  # noqa: B023
                return x

            def of(k: int) -> np.ndarray:
                if k not in found:  # noqa: B023
                    found[k] = shingles(rows["text"][k])  # noqa: B023
                return found[k]  # noqa: B023

            out = []
            for k, others in enumerate(rows["band"]):  # here the lists of others
                for r in others or ():
                    o = place[r]
                    x, y = root(rows["label"][k]), root(rows["label"][o])
                    if x == y:
                        continue
                    few, many = sorted((len(of(k)), len(of(o))))
                    if few >= threshold * many and overlap(of(k), of(o)) >= threshold:
                        out.append((rows["rid"][k], r))
                        parent[max(x, y)] = min(x, y)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(u, v) with v the smallest node of u's component, for each u that isn't it.

    Alternates the large-star and small-star contractions until edges no longer change; each
    round is two aggregations over edges, whatever the length of chains.
    """
    now = space.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    mark = None
    for k in itertools.count(1):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        space_now = space.stage(small, f"{name}-{k}")
        got = space_now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        space.drop(f"{name}-{k - 1}")
        now = space_now
        if got == mark:
            return now
        mark = got
    raise AssertionError


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, space: Workspace | None = None) -> DataFrame:
    """doc_id, class_id, group_size, kept, rid, hash for every row; class_id is the doc_id that stays."""
    spark = docs.sparkSession
    prepare(spark)
    space = space or Workspace(spark, "near")
    signed = space.stage(_sign(docs), "signed")
    rows = signed.select("rid", "doc_id", "hash", "fp")
    # One row stands for all with its multiset.
    groups = space.stage(rows.groupBy("fp").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")), "groups")
    heads = signed.select(F.col("rid").alias("rep"), "bands").join(groups.select("rep"), "rep")
    # Keys lie in ``bands`` as they are told apart here: eight bytes each, the band in their order.
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("bands", 8 * i + 1, F.lit(8)))
    buckets = heads.select(F.posexplode(keys).alias("band", "key"), F.col("rep").alias("rid"))
    several = buckets.groupBy("key").agg(F.min("rid").alias("first"), F.max("rid").alias("last"), F.count(F.lit(1)).alias("size")).where("first < last").drop("first", "last")
    members = space.stage(buckets.join(several, "key"), "members")
    wanted = members.select("rid").distinct().join(signed.select("rid", "doc_id", "hash", "sketch", "bands"), "rid")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.col("text").cast("string")).alias("h"), text.alias("text"))
    # A stretch of candidates' texts; of rows with one doc_id and text any serves.
    same = wanted["doc_id"].eqNullSafe(whole["d"]) & (wanted["hash"] == whole["h"])
    texts = space.stage(whole.join(wanted, same).select("rid", "text", "sketch", "bands").dropDuplicates(["rid"]), "texts", compression="zstd")
    space.sweep()
    labels = space.stage(members.select("rid", F.col("rid").alias("label")).distinct(), "labels-0")

    def relabel(links: DataFrame, k: int) -> DataFrame:
        """Labels after joining the classes that links connect."""
        a, b = (labels.select(F.col("rid").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        edges = links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        parts = components(edges, space, f"edges-{k}")
        return space.stage(labels.join(parts, labels["label"] == parts["u"], "left").select("rid", F.coalesce("v", "label").alias("label")), f"labels-{k}")

    # First each document with the pivot that it shares most buckets with. Copies of one text meet it
    # more often than each other, so a bucket's pivot is the member with most partners in all its buckets.
    met = members.groupBy("rid").agg(F.sum("size").alias("met"))
    ranked = members.select("rid", "key").join(met, "rid")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("met", (-F.col("rid")).alias("rid"))).alias("x")).select("key", (-F.col("x.rid")).alias("pivot"))
    shared = members.select("rid", "key").join(pivots, "key").where("rid <> pivot").groupBy("rid", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(F.col("rid").alias("a")).agg(F.max(F.struct("n", "pivot")).alias("x")).select("a", F.col("x.pivot").alias("b"))
    labels = relabel(space.stage(_verify(best, texts.select("rid", "text"), threshold), "links-1"), 1)
    space.sweep()

    # Then what is left of each bucket, in blocks of two chunks.
    known = members.join(labels, "rid")
    open_ = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    left = space.stage(known.join(open_, "key"), "open")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    chunked = left.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    spread = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rid", "label", F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"), "band")
    joined = spread.join(texts.select("rid", "sketch", "bands"), "rid")
    dealt = joined.repartition(*UNIT).sortWithinPartitions(*UNIT, "rid").select(*UNIT, "rid", "label", "side", "band", "sketch", "bands")
    lists = space.stage(dealt.mapInArrow(_candidates, "key binary, i int, j int, rid long, others array<long>"), "lists")
    if not lists.isEmpty():
        needed = lists.withColumnRenamed("others", "band")
        with_text = needed.join(labels, "rid").join(texts.select("rid", "text"), "rid").withColumn("side", F.lit(0))
        dealt = with_text.repartition(*UNIT).sortWithinPartitions(*UNIT, "rid").select(*UNIT, "rid", "label", "side", "band", "text")
        links = space.stage(dealt.mapInArrow(_links(threshold), "a long, b long"), "links-2")
        if not links.isEmpty():
            labels = relabel(links, 2)
    space.sweep()

    total = rows.count()
    hot = groups.where(F.col("n") >= F.lit(max(1000, int(total * HOT_PART)))).select("fp")
    named = groups.join(labels, groups["rep"] == labels["rid"], "left").select("fp", "rep", F.coalesce("label", "rep").alias("label"))
    placed = space.stage(salted(spark, rows, named.select("fp", "label"), "fp", hot), "placed")
    stays = placed.groupBy("label").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rid")).alias("stays"))
    stays = space.stage(stays.select("label", "group_size", F.col("stays.doc_id").alias("class_id"), F.col("stays.rid").alias("keep")), "stays")
    hot = stays.where(F.col("group_size") >= F.lit(max(1000, int(total * HOT_PART)))).select("label")
    out = salted(spark, placed, stays, "label", hot)
    return out.select("doc_id", "class_id", "group_size", (F.col("rid") == F.col("keep")).alias("kept"), "rid", "hash")
