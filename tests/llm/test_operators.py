"""Each training-data operator against brute force, an exact round trip or held-out accuracy."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytegrove.llm import contexts, exact_dedup, jpeg, katz, language_id, mixing, near_dedup, packing, substring_dedup, token_orc, token_rollup
from bytegrove.llm.common import LOWER, ChunkEncoder, Workspace, encoder, keep_rows, vocabulary

VOCAB = vocabulary("word_bpe_49k.json")
WORDS = ["the", "of", "and", "Sun", "rain", "over", "hill", "é", "river", "stone", "42", "wind", "don't", "Über", "long", "path"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, `end` string, label int"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.choice([0, 1, 3, 30, 80, 200])))
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "B", "é", None]), len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, rows[4][1], "en", "b", 1), (103, rows[4][1], "en", "a", 1), (104, "x " * 5000, "en", "a", 1), (105, " \t\n", "en", "b", 3)]
    rows += [rows[7], rows[7]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text, end):
    return [*encoder(VOCAB).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- tokens -----------------------------------------------------------------------------


def test_chunk_encoder_equals_whole_texts():
    rng = random.Random(3)
    odd = ["a", "Z", "é", "É", "'", "'s", "1", "²", "ª", "İ", "ß", "Σ", "é", "́", "<|endoftext|>", "<|", "!", "...", " ", "\n", "\t", " ", " ", "\x1c", "日本", "ﬁ", "don't", "😀", "_", "ŉ", "ſ", "\r\n", "\x85", "word"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(1500)] + ["", None, "y" * 500]
    e = ChunkEncoder(VOCAB)
    for start in (0, 700):  # the second time from the cache
        for text, got in zip(texts[start:], e.encode(texts[start:], b""), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_orc_round_trip(spark, docs, empty, tmp_path):
    token_orc.write_token_orc(docs, f"{tmp_path}/ids", VOCAB, 4)
    stored = token_orc.read_token_orc(spark, f"{tmp_path}/ids")
    got = [tuple(r) for r in token_orc.token_digests(stored).orderBy("doc_id", "start").collect()]
    want, start = [], 0
    for doc, text, *_ in sorted(corpus(), key=lambda r: r[0]):
        ids = ids_of(text, 2)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert stored.where("doc_id = 104").count() == 1
    token_orc.write_token_orc(empty, f"{tmp_path}/none", VOCAB, 2)
    assert token_orc.token_digests(token_orc.read_token_orc(spark, f"{tmp_path}/none")).count() == 0


def test_packing(spark, docs, empty):
    packed = packing.pack(docs, VOCAB)
    rows = packing.packing_digests(packed).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    texts = collections.defaultdict(list)
    for doc, text, *_ in corpus():
        texts[doc].append(text)
    for doc, same in texts.items():
        ids = ids_of(same[0], 0)
        want = sorted((k, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048)))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]) == sorted(want * len(same))
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) == -(-sum(r["length"] for r in rows) // 2048)
    assert packed.sequences().select(F.sum("n_tokens")).first()[0] == sum(r["length"] for r in rows)
    assert packing.packing_digests(packing.pack(empty, VOCAB)).count() == 0


def test_local_search_empties_bins():
    # No piece of the last bin fits elsewhere: 4 goes for 2, then 2 moves.
    sizes = np.array([5, 3, 6, 2, 4], "int64")
    got = packing.local_search(sizes, [[0, 1], [2, 3], [4]], 10)
    assert len(got) == 2 and sorted(i for b in got for i in b) == list(range(5))
    # Two for one: 3 and 3 go for 4, then 4 moves.
    sizes = np.array([6, 4, 8, 3, 3, 6], "int64")
    assert len(packing.local_search(sizes, [[0], [1, 2], [3, 4], [5]], 12)) == 3
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 100, 60)
        start = packing.best_fit(sizes, 100)
        got = packing.local_search(sizes, [list(b) for b in start], 100)
        assert len(got) <= len(start) and sorted(i for b in got for i in b) == list(range(60)) and all(sizes[b].sum() <= 100 for b in got)


def test_token_rollup(spark, docs, empty, tmp_path):
    old = token_rollup.count_tokens(docs, VOCAB, "v1")
    new = token_rollup.count_tokens(docs, VOCAB, "v2").withColumn("n_tokens", F.col("n_tokens") + 1)
    ledger = token_rollup.TokenRollup(spark, f"{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("one", token_rollup.inserts(old))
    assert not ledger.commit("one", token_rollup.inserts(old))
    gone = F.col("doc_id") % 3 == 0
    assert ledger.commit("two", token_rollup.deletes(old.where(gone)))
    assert ledger.commit("three", token_rollup.revisions(old.where(~gone), new.where(~gone)))
    assert ledger.commit("four", token_rollup.inserts(token_rollup.count_tokens(empty, VOCAB, "v1")))
    want = collections.Counter()
    for doc, text, lang, source, _ in corpus():
        if doc % 3:
            want[(source, lang, "v2", "docs")] += 1
            want[(source, lang, "v2", "tokens")] += len(ids_of(text, 0))
    got = collections.Counter()
    for r in ledger.totals().collect():
        got[(r["source"], r["lang"], r["tokenizer"], "docs")] = r["n_docs"]
        got[(r["source"], r["lang"], r["tokenizer"], "tokens")] = r["n_tokens"]
    assert got == want
    assert ledger.rollup().where("level = 7").first()["n_docs"] == sum(v for k, v in want.items() if k[3] == "docs")


# --- copies -----------------------------------------------------------------------------


def exact_by_hand():
    groups = collections.defaultdict(list)
    for doc, text, *_ in corpus():
        groups[text or ""].append(doc)
    return sorted((d, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, empty, weak):
    digest = (lambda t: F.encode(F.pmod(F.xxhash64(t), F.lit(3)).cast("string"), "UTF-8")) if weak else exact_dedup.sha256
    sized = docs if not weak else docs.withColumn("text", F.rpad(F.coalesce("text", F.lit("")), 12000, "#"))  # equal sizes clash, too
    rows = exact_dedup.exact_groups(sized, digest).collect()
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in exact_by_hand()]
    if not weak:
        assert got == exact_by_hand()
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})
    assert all(r["kept"] <= (r["doc_id"] == r["keep_id"]) for r in rows)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_state_goes_on(spark, tmp_path):
    schema = "doc_id long, row_tag long, digest binary, n_bytes long"
    for k, rows in enumerate([[(1, 1, b"a", 1), (2, 2, b"b", 1)], [(3, 3, b"a", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch{k}")
        exact_dedup.ingest(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/cp", {"maxFilesPerTrigger": "1"})
        exact_dedup.ingest(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/cp")  # nothing new
    got = sorted((bytes(r["digest"]), r["n"], r["keep_id"]) for r in exact_dedup.read_state(spark, f"{tmp_path}/cp").collect())
    assert got == [(b"a", 2, 3), (b"b", 1, 2)]


def test_keep_rows(spark, docs):
    left = keep_rows(docs, exact_dedup.exact_groups(docs).select("doc_id", "hash", "kept"))
    assert left.columns == docs.columns
    texts = [r["text"] or "" for r in left.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in corpus()})


def near_corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    for start in (7, 60):  # copies that drift away from the first one, link by link
        drift = [rng.choice(words) for _ in range(200)]
        for k in range(14):
            rows.append((len(rows), " ".join(drift)))
            for _ in range(3):
                drift[(start + 13 * k + rng.randrange(200)) % 200] = rng.choice(words)
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "!!! ???"), (len(rows) + 3, "W1, w2. w3 w4 w5"), (len(rows) + 4, "w1 w2 W3 w4 w5"), rows[0], rows[0]]
    rows.append((len(rows) + 9, " ".join(["la la la la la la"] * 30)))
    rows.append((len(rows) + 9, " ".join(["la la la la la la"] * 28)))
    rows.append((len(rows) + 9, "la la la la la la"))
    return rows


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_dedup(spark, empty, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rows = near_corpus()
    sets = [near_dedup.shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and near_dedup.overlap(sets[i], sets[j]) >= near_dedup.THRESHOLD:
                label = [label[j] if x == label[i] else x for x in label]
    classes = collections.defaultdict(list)
    for k, x in enumerate(label):
        classes[x].append(rows[k][0])
    want = sorted((d, min(g), len(g)) for g in classes.values() for d in g)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(classes)
    assert near_dedup.near_classes(empty).count() == 0


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(2)
    a = np.sort(near_dedup.mix64(rng.integers(0, 300, 900).astype("u8")))
    errors = []
    for k in range(40):
        mixed = np.sort(np.concatenate([a[: 400 + 10 * k], near_dedup.mix64(rng.integers(300, 500, 200).astype("u8"))]))
        x, y = near_dedup.signatures([a + np.uint64(k), mixed + np.uint64(k)], 512)
        errors.append((x == y).mean() - near_dedup.overlap(a + np.uint64(k), mixed + np.uint64(k)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    label = {}
    for a, b in edges:
        x, y = label.get(a, a), label.get(b, b)
        low = min(x, y)
        label.update({k: low for k, v in label.items() if v in (x, y)})
        label[a] = label[b] = low
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "e").collect()
    smallest = {k: min(j for j, w in label.items() if w == v) for k, v in label.items()}
    assert {r["u"]: r["v"] for r in got} == {k: v for k, v in smallest.items() if k != v}


def test_passages(spark, empty):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(4000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(70)
    fuzzy = list(passage)
    fuzzy[20], fuzzy[45:46] = "other", []
    rows = [(0, text(100) + passage + text(50)), (1, text(10) + fuzzy + text(80)), (2, passage), (3, text(200)), (4, passage[:30] + text(40)), (5, text(300)), (6, [])]
    rows.append((7, list(rows[5][1])))
    rows.append((8, passage[:5] + text(1)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(9, None)], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["start"], r["end"], r["first_id"], r["first_start"], r["first_end"]) for r in substring_dedup.passages(df, block_tokens=150).collect()}
    assert got == {(1, 10, 79, 0, 100, 170), (2, 0, 70, 0, 100, 170), (7, 0, 300, 5, 0, 300)}
    assert substring_dedup.passages(empty).count() == 0


def test_passages_of_many_partitions(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3)]
    at = {130: 0, 140: 0, 256: 1, 290: 1, 0: 2, 299: 2}
    df = spark.sparkContext.parallelize(range(300), 300).map(lambda i: (i, texts[at[i]] if i in at else f"only {i}")).toDF("doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["end"], r["first_id"], r["first_start"], r["first_end"]) for r in substring_dedup.passages(df).collect()}
    assert got == {(140, 0, 60, 130, 0, 60), (290, 0, 60, 256, 0, 60), (299, 0, 60, 0, 0, 60)}


def test_passages_of_frequent_lines(spark):
    """Each run of MIN_WORDS words that an earlier document has is in a passage, however often its lines occur."""
    rng = random.Random(11)
    lines = [[f"w{rng.randrange(10**6)}" for _ in range(12)] for _ in range(30)]
    rest = lambda: [f"x{rng.randrange(10**9)}" for _ in range(9)]
    texts = [sum((lines[k] + rest() for k in rng.sample(range(30), 3)), []) for _ in range(40)]
    for _ in range(12):
        passage = [lines[k] for k in rng.sample(range(30), 6)]
        texts += [rest() + passage[k] + passage[k + 1] + rest() for k in range(5)]  # also where lines meet
        texts += [rest() + sum(passage, []) + rest() for _ in range(2)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    covered = collections.defaultdict(set)
    for r in substring_dedup.passages(df, block_tokens=400).collect():
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    n, seen, due = substring_dedup.MIN_WORDS, set(), 0
    for d, t in enumerate(texts):
        runs = [tuple(t[k : k + n]) for k in range(len(t) - n + 1)]
        for k, run in enumerate(runs):
            if run in seen:
                due += 1
                assert covered[d] >= set(range(k, k + n)), (d, k)
        seen.update(runs)
    assert due > 100


def test_passages_with_few_anchors(spark):
    """One anchor is enough, and a passage goes on as far as the texts are alike."""
    rng = random.Random(21)
    text = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    keys = lambda words: set(substring_dedup.seeds(np.array([near_dedup.word_hash(w.encode()) for w in words], "u8"), np.zeros(len(words), "int64"))[0].tolist())

    def pair(n, alike):
        """Four words alike and one not, but for one run of ``alike`` words in the middle."""
        a = text(n)
        return a, [w if k % 5 or 0 <= k - n // 2 < alike else f"z{w}" for k, w in enumerate(a)]

    long = pair(900, 12)
    short = next(p for p in iter(lambda: pair(60, 9), None) if len(keys(p[0]) & keys(p[1])) == 1)
    rows = [text(30) + short[0] + text(30), text(20) + long[0] + text(20), text(40) + short[1] + text(10), text(50) + long[1] + text(60)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in substring_dedup.passages(df).collect()}
    assert sorted(got) == [2, 3]
    for d, first, at, first_at, p in ((2, 0, 40, 30, short), (3, 1, 50, 20, long)):
        r, n = got[d], len(p[0])
        assert r["first_id"] == first and r["start"] - at == r["first_start"] - first_at
        assert abs(r["start"] - at) <= 1 and abs(r["end"] - at - n) <= 1


def test_passages_whose_seeds_are_first_elsewhere(spark):
    """Two documents are linked, too, where each seed that they share is first in another document."""
    rng = random.Random(31)
    text = lambda n: [f"p{rng.randrange(10**9)}" for _ in range(n)]
    keys = lambda words: set(substring_dedup.seeds(np.array([near_dedup.word_hash(w.encode()) for w in words], "u8"), np.zeros(len(words), "int64"))[0].tolist())
    rows, due = [], []
    for n, step, gone in ((60, 7, 0), (70, 9, 0), (100, 6, 0), (70, 14, 1), (90, 13, 2)):
        for _ in range(5):
            a = text(n)
            b = [w if k % step else f"s{w}" for k, w in enumerate(a, 1)]
            for k in range(gone):
                del b[(k + 1) * n // (gone + 1)]
            # Each run of twelve words of it is in an earlier document, with other words around.
            rows += [text(20) + a[k : k + 12] + text(20) for k in range(n - 11)]
            a, b = text(20) + a + text(20), text(30) + b + text(10)
            if len(keys(a) & keys(b)) > gone:
                due.append((len(rows) + 1, len(rows), gone))
            rows += [a, b]
    # A place after another one of its seed in the same document.
    a = text(60)
    b = [w if k % 7 else f"s{w}" for k, w in enumerate(a, 1)]
    due.append((len(rows) + 1, len(rows), 0))
    rows += [sum((a[k : k + 6] + text(3) for k in range(0, 60, 7)), []) + a + text(9), b + text(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(2)
    found = {(r["doc_id"], r["first_id"]) for r in substring_dedup.passages(df, block_tokens=3000).collect()}
    assert found <= {p[:2] for p in due} and len(due) > 20
    assert found >= {p[:2] for p in due if not p[2]}
    assert len(found) >= 0.9 * len(due)


def test_places_are_compared_in_order():
    """Words around a seed that are alike at other distances count in their order alone, as an alignment has them."""
    rng = random.Random(41)
    words = np.array([rng.randrange(1, 30) for _ in range(3000)], "u8")
    at = np.array([rng.randrange(2990) for _ in range(200)])
    low, high = (np.array([f(p) for p in at.tolist()]) for f in (lambda p: max(0, p - rng.randrange(70)), lambda p: min(3000, p + 5 + rng.randrange(70))))
    x = contexts.numbers(contexts.contexts(words, low, high, at, 5))
    a, b = (np.array([rng.randrange(200) for _ in range(300)]) for _ in range(2))
    most, bag = contexts.sides_in_order(x[:, a], x[:, b]), contexts.sides_common(contexts.bags(x), a, b)
    sides = lambda i: (words[max(low[i], at[i] - 48) : at[i]][::-1], words[at[i] + 5 : min(high[i], at[i] + 53)])
    for n, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        for side, (u, v) in enumerate(zip(sides(i), sides(j), strict=True)):
            same = sum((collections.Counter(u.tolist()) & collections.Counter(v.tolist())).values())
            assert most[side][n] == substring_dedup.common_words(u, v) <= same <= bag[side][n]
    # Ten words before the seed are alike, then 38 in another order; or all 48 after one more word.
    near, mixed, own = (list(range(s, s + 48)) for s in (10, 100, 200))
    turned = near[:10] + [w for k in range(10, 48, 10) for w in near[k : k + 10][::-1]]
    seed = [1, 2, 3, 4, 5]
    for side, due in ((turned, 0), (near[:10] + [99] + near[10:47], 1)):
        docs = [near[::-1] + seed + mixed, side[::-1] + seed + own]
        flat = np.array(sum(docs, []), "u8")
        low = np.array([0, len(docs[0])])
        raw = contexts.contexts(flat, low, low + 101, low + 48, 5)
        n = [0, 0]
        columns = {"key": n, "i": n, "j": n, "side": n, "block": n, "doc": [0, 1], "place": [48, 48], "label_block": n, "label_doc": [0, 1], "label_from": n, "label_to": [101, 101], "context": [r.tobytes() for r in raw]}
        batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "context" else pa.int64()) for k, v in columns.items()})
        assert sum(out.num_rows for out in contexts.paired(35, 30, 50)(iter([batch]))) == due


def test_pairs_that_hold_no_passage_are_not_aligned(monkeypatch):
    """Documents of runs of one word share many seeds: those without a passage aren't aligned, those with one are."""
    rng = random.Random(43)
    docs = [[w for _ in range(12) for w in [rng.randrange(1, 200)] * rng.randrange(15, 48)] for _ in range(40)]
    for k in range(20, 40):
        some = docs[k - 20][60:140]
        docs[k] = docs[k][:100] + [w if rng.random() < 0.9 else 999 for w in some] + docs[k][100:]
    starts = {i: {} for i in range(40)}
    for i, d in enumerate(docs):
        for p in range(len(d) - 4):
            if len({*d[p : p + 5]}) == 1 and (p == 0 or d[p - 1] != d[p] or d[p + 5 : p + 6] != [d[p]]):
                starts[i].setdefault(d[p], []).append(p)
    raw = [substring_dedup._short(np.array(d, "u8")).tobytes() for d in docs]
    rows = []
    for i in range(40):
        for j in range(i):
            at = [{"place": p, "far": q} for w in starts[i] for p in starts[i][w] for q in starts[j].get(w, ())]
            if at:
                rows.append({"doc_id": i, "first_id": j, "block": 0, "doc": i, "other_block": 0, "other_doc": j, "own_words": raw[i], "words": raw[j], "at": at})
    batch = pa.RecordBatch.from_pylist(rows)
    aligned = []
    chains = substring_dedup.chains
    monkeypatch.setattr(substring_dedup, "chains", lambda *a: aligned.append(1) or chains(*a))
    found = lambda: sorted((tuple(r.values()) for out in substring_dedup._align_rest(iter([batch])) for r in out.to_pylist()), key=str)
    some = found()
    assert 20 <= len({r[:1] + r[3:4] for r in some}) <= len(aligned) < len(rows) / 2
    monkeypatch.setattr(substring_dedup, "_rest_alike", lambda batch: np.ones(batch.num_rows, bool))
    assert found() == some


def test_passages_of_repeating_phrases(spark):
    """Runs at many distances from one place don't use up each other's anchors."""
    rng = random.Random(13)
    text = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for size in (1, 2, 3, 7, 11):
        phrase = text(size)
        texts += [text(20) + phrase * -(-n // size) + text(20) for n in (67, 140, 300)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    covered = collections.defaultdict(set)
    for r in substring_dedup.passages(df).collect():
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    n, seen = substring_dedup.MIN_WORDS, set()
    for d, t in enumerate(texts):
        runs = [tuple(t[k : k + n]) for k in range(len(t) - n + 1)]
        for k, run in enumerate(runs):
            assert run not in seen or covered[d] >= set(range(k, k + n)), (d, k)
        seen.update(runs)


def test_extensions_match_brute_force():
    """Words go on alike until their score (1 for equal, -2 for different) is more than DROP below its best."""
    draw = random.Random(5)
    for _ in range(3000):
        x = [draw.randrange(3) for _ in range(draw.randrange(40))]
        y = [w if draw.random() < 0.8 else 3 for w in x][: draw.randrange(len(x) + 1)]
        score = best = taken = same = equal = 0
        ended = False
        for i, (v, w) in enumerate(zip(x, y, strict=False), 1):
            score, equal = score + (1 if v == w else -2), equal + (v == w)
            if score > best:
                best, taken, same = score, i, equal
            if best - score > substring_dedup.DROP:
                ended = True
                break
        assert substring_dedup.extend(np.array(x, "u4"), np.array(y, "u4")) == (taken, same, ended)


def test_chains_match_brute_force():
    rng = random.Random(4)
    k = substring_dedup.K
    for _ in range(150):
        n = rng.randint(1, 14)
        a, b = (np.array([rng.randint(0, 40) for _ in range(n)]) for _ in range(2))
        pairs = sorted(set(zip(a.tolist(), b.tolist(), strict=True)))
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        best = [float(k)] * len(pairs)
        for i, (x, y) in enumerate(pairs):
            for j, (u, v) in enumerate(pairs[:i]):
                if u < x and v < y and x - u <= substring_dedup.MAX_GAP + k and y - v <= substring_dedup.MAX_GAP + k:
                    best[i] = max(best[i], best[j] + min(k, x - u, y - v) - substring_dedup.GAP_COST * (x - u + y - v))
        found = substring_dedup.chains(a, b)
        assert sorted(i for c in found for i in c.tolist()) == list(range(len(pairs)))
        for c in found:
            assert np.all(np.diff(a[c]) > 0) and np.all(np.diff(b[c]) > 0)


def test_chains_of_two_passages_match_brute_force():
    """A long chain far off doesn't hide the near predecessors of a second one."""
    rng = random.Random(8)
    k, reach, cost = substring_dedup.K, substring_dedup.MAX_GAP + substring_dedup.K, substring_dedup.GAP_COST
    gain = lambda p, q: min(k, q[0] - p[0], q[1] - p[1]) - cost * (q[0] - p[0] + q[1] - p[1])
    for trial in range(60):
        pairs = {(4 * i, 4 * i) for i in range(30)} | {(300 + 6 * i + i // 4, 300 + 6 * i) for i in range(12)}
        pairs |= {(rng.randrange(400), rng.randrange(400)) for _ in range(trial)} | {(340 + 6 * i, 6 * i) for i in range(trial % 9)}
        pairs = sorted(pairs)
        best = [float(k)] * len(pairs)
        for i, (x, y) in enumerate(pairs):
            for j, (u, v) in enumerate(pairs[:i]):
                if u < x and v < y and x - u <= reach and y - v <= reach:
                    best[i] = max(best[i], best[j] + gain((u, v), (x, y)))
        found = substring_dedup.chains(*(np.array(x) for x in zip(*pairs, strict=True)))
        assert sorted(i for c in found for i in c.tolist()) == list(range(len(pairs)))
        score = [k + sum(gain(pairs[p], pairs[q]) for p, q in zip(c[:-1], c[1:], strict=True)) for c in found]
        assert max(score) == pytest.approx(max(best))
        second = max(range(len(pairs)), key=lambda i: best[i] if pairs[i][0] >= 300 else 0)
        assert any(second in c and len(c) >= 12 for c in found)


# --- mixing -----------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    assert mixing.targets([0, 10], [5, 2]) == [0, 10]
    assert mixing.targets([], []) == []


def test_split_tree_keeps_quotas():
    q = np.array([100, 7, 0, 31])
    tree = mixing.split_tree(q, 8, np.random.default_rng(0))
    assert tree.shape == (8, 4) and (tree.sum(0) == q).all() and tree.sum(1).max() - tree.sum(1).min() <= 3


def test_mixing(spark, docs, empty):
    rows = [tuple(r) for r in mixing.mixing_digests(mixing.mix(docs)).orderBy("doc_id").collect()]
    again = [tuple(r) for r in mixing.mixing_digests(mixing.mix(docs.repartition(5))).orderBy("doc_id").collect()]
    assert rows == again and len(rows) == len(corpus())
    words = lambda t: len((t or "").encode().split())
    size = collections.Counter()
    for _, text, _, source, _ in corpus():
        size[source] += words(text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [5, 2, 1, 5, 2]), strict=True))
    source = {r[0]: r[3] for r in corpus()}
    taken = collections.Counter()
    for doc, n, source_size, target, took, *_ in rows:
        assert source_size == size[source[doc]] and target == pytest.approx(want[source[doc]]) and took % n == 0 if n else took == 0
        assert took <= 3 * n
        taken[source[doc]] += took
    for s in order:
        largest = max(words(r[1]) for r in corpus() if r[3] == s)
        assert abs(taken[s] - want[s]) <= largest / 2  # a document is taken whole
    mixed = mixing.mixed_documents(docs, mixing.mix(docs))
    assert mixed.columns == docs.columns
    assert sum(words(r["text"]) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mixing_digests(mixing.mix(empty)).count() == 0


# --- models -----------------------------------------------------------------------------


def test_katz(spark, docs, empty):
    got = katz.katz_scores(docs, block_tokens=700, partition_keys=300).collect()
    texts = [(r[0], (r[1] or "").encode().translate(LOWER).split() + [katz.END]) for r in corpus()]
    train = [(d, t) for d, t in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for _, t in train for w in t)
    pairs = collections.Counter(p for _, t in train for p in zip([katz.END, *t[:-1]], t, strict=True))
    n, v = sum(c.values()), len(c)
    d1, d2 = (katz.discounts(collections.Counter(x.values())) for x in (c, pairs))
    cut = lambda d, r: d[min(r, len(d) - 1)]
    kept = sum(cut(d1, r) * r for r in c.values()) / n
    uni = lambda w: cut(d1, c[w]) * c[w] / n if c[w] else 1 - kept
    count, alpha = {}, {}
    for a in c:
        after = [(b, r) for (x, b), r in pairs.items() if x == a]
        held = sum(cut(d2, r) * r for _, r in after)
        count[a] = c[a] + (1 - held / c[a] < 1e-9)
        alpha[a] = (1 - held / count[a]) / (1 - sum(uni(b) for b, _ in after))
    p = lambda a, b: cut(d2, pairs[a, b]) * pairs[a, b] / count[a] if pairs[a, b] else alpha.get(a, 1) * uni(b)
    for a in list(c)[:5] + ["unknown"]:
        total = sum(p(a, b) for b in c) + alpha.get(a, 1) * (1 - kept)
        assert total == pytest.approx(1)  # exactly normalised, the unknown word included
    want = []
    for d, t in texts:
        score = sum(math.log10(p(a, b)) for a, b in zip([katz.END, *t[:-1]], t, strict=True))
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want.append((d, zlib.crc32(str(d).encode()) % 7 == 2, len(t), sum(w in c for w in t), n, base, score))
    for g, w in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])
    assert katz.katz_scores(empty).count() == 0


def test_katz_beats_the_base_on_held_out_text(spark):
    rng = random.Random(8)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}
    rows = []
    for i in range(300):
        t = [rng.choice(WORDS)]
        while len(t) < 60:
            t.append(rng.choice(follow[t[-1]]))
        rows.append((i, " ".join(t)))
    held = [r for r in katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def lang_rows():
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["der", "sch", "ung", "und", "ä"], "es": ["que", "ción", "los", "ñ", "ar"], "fr": ["eau", "les", "eux", "ê", "ç"]}
    word = lambda x: "".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(word(x) for _ in range(rng.randint(5, 60))), x, f"s{i % 3}") for i, x in enumerate(list(parts) * 60)]


def test_language_id(spark, empty):
    rows = lang_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(df.where("doc_id < 120"))
    extra = spark.createDataFrame([(900, None, None, None), (901, "", "en", "s0"), (902, "0x8f 77 @@@ 93 $$ 44 " * 20, "en", "s0"), (903, "日本語の文章です。" * 9, "en", None)], df.schema)
    got = {r["id"]: r for r in language_id.identify(language_id.document_evidence(df.where("doc_id >= 120").unionByName(extra)), model).collect()}
    held = rows[120:]
    assert sum(got[r[0]]["lang"] == r[2] and got[r[0]]["kept"] for r in held) >= 0.98 * len(held)
    assert not any(got[k]["kept"] for k in (900, 901, 902, 903))
    assert language_id.identify(language_id.document_evidence(empty), model).count() == 0
    pages = [
        (1, "https://a.example.com/de/1", '<html lang="de"><p>ab</p></html>'),
        (2, "https://a.example.fr/x", "<HTML><script>the and wh</script>ar</html>"),
        (3, None, None),
        (4, "https://b.example.com/", '<html lang="de">' + "the tion and wh ing " * 20),
    ]
    got = {r["id"]: (r["lang"], r["kept"]) for r in language_id.identify(language_id.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    assert got[1][0] == "de" and got[4] == ("en", True) and not got[3][1]


def test_host_priors_decide_short_texts(spark):
    rows = lang_rows()
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    pages = [(k, f"https://h.example.com/{k}", r[1]) for k, r in enumerate(r for r in rows if r[2] == "fr")]
    pages += [(1000, "https://h.example.com/x", "zqx"), (1001, None, "zqx")]
    got = {r["id"]: r for r in language_id.identify(language_id.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")), model).collect()}
    share = lambda r: r["posterior"] if r["lang"] == "fr" else 0
    assert share(got[1000]) > 0.5


# --- media ------------------------------------------------------------------------------


def test_jpeg_round_trip(docs, empty):
    rows = {r["doc_id"]: r for r in jpeg.media_features(jpeg.media_column(docs)).collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in jpeg.media_column(docs).collect()}
    for doc, text, *_ in corpus():
        t = (text or "").encode()
        p = t + b"\xff" * (-len(t) % 576 or (0 if t else 576))
        r = rows[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[doc]), hashlib.sha256(media[doc]).hexdigest())
    assert rows[102]["feature"] == rows[103]["feature"]
    assert jpeg.media_features(jpeg.media_column(empty)).count() == 0


def test_jpeg_of_very_long_text():
    t = bytes(range(256)) * 8000
    image = jpeg.parse(jpeg.encode([t])[0])
    got, n = jpeg.payload(image, jpeg.coefficients([image])[0])
    assert n == len(t) and got == jpeg.padded(t) and image.height < 65536


def test_decoder_reads_other_files():
    """A hand-made 16x8 image of two blocks: several code lengths, runs, DC prediction, no restarts."""
    dc = bytes([1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 1])
    ac = bytes([0, 1, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0x01, 0x00, 0x11])
    # DC codes: 0 (two bits follow), 10 (one bit). AC codes: 00 (no zeros, one bit), 010 (end), 011 (one zero, one bit).
    bits = "0" + "10" + "00" + "1" + "010" + "10" + "0" + "011" + "0" + "010"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big")
    seg = jpeg._segment
    media = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([16] * 64)) + seg(0xC0, b"\x08\0\x08\0\x10\1\1\x11\0") + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, b"\1\1\0\0\x3f\0") + scan.replace(b"\xff", b"\xff\0") + b"\xff\xd9"
    image = jpeg.parse(media)
    coef = jpeg.coefficients([image])[0]
    assert coef[0, :3].tolist() == [2, 1, 0] and not coef[0, 3:].any()
    assert coef[1, :3].tolist() == [2 - 1, 0, -1] and not coef[1, 3:].any()
    thumb = jpeg.thumbnail(image, coef)
    assert thumb.tolist() == [[132, 130]]
    assert len(jpeg.thumbnail_hash(thumb)) == 16
