"""Single steps against brute force, damaged input, and the pipeline stage by stage."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bytegrove.llm import jpeg, katz, mixing, near_dedup, packed, substring_dedup, token_rollup
from bytegrove.llm.common import LOWER, ChunkEncoder, split_words, text_slices, vocabulary


def test_split_words():
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "B", "é", " ", "\n", "\t", "\x0b", "\x1c", "日", ""], k=rng.randint(0, 12))) for _ in range(400)] + [None, ""]
    codes, words, counts = split_words(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert [words[c] for c in codes[at : at + n]] == (t or "").encode().translate(LOWER).split()
        at += n
    assert at == len(codes)
    assert near_dedup.word_hashes([b"a", b"...", b"A.", b"\xc3\x89,", "é".encode()]).tolist()[1] == 0
    assert near_dedup.word_hash(b"a") == near_dedup.word_hash(b"A.") and near_dedup.word_hash("É,".encode()) == near_dedup.word_hash("é".encode())


def test_text_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (0, 5, 9, 40, 1, 0)])], ["text"])
    assert list(text_slices(batch, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_other_vocabularies_get_whole_texts():
    e = ChunkEncoder(vocabulary("byte_bpe_50k.json"))
    texts = ["a  b\n\nc", None, "", "Don't  stop 42"]
    assert not e.wordwise
    ids, sizes = e.encode_column(pa.array(texts), 7)
    want = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert ids.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]


def test_best_predecessors_match_brute_force():
    rng = random.Random(1)
    k, reach, cost = substring_dedup.K, substring_dedup.MAX_GAP + substring_dedup.K, substring_dedup.GAP_COST
    for _ in range(400):
        wide = rng.choice([20, 40, 120, 300])
        pairs = {(rng.randint(0, wide), rng.randint(0, rng.choice([5, wide]))) for _ in range(rng.randint(1, 40))}
        if rng.random() < 0.3:
            pairs |= {(3 * i + rng.randint(0, 1), 3 * i) for i in range(30)}
        pairs = sorted(pairs)
        best = [float(k)] * len(pairs)
        for i, (x, y) in enumerate(pairs):
            for j, (u, v) in enumerate(pairs[:i]):
                if u < x and v < y and x - u <= reach and y - v <= reach:
                    best[i] = max(best[i], best[j] + min(k, x - u, y - v) - cost * (x - u + y - v))
        score, back = substring_dedup._best_predecessors(*(np.array(c) for c in zip(*pairs, strict=True)), k)
        assert score == pytest.approx(best)
        assert all(b < 0 or (pairs[b][0] < pairs[i][0] and pairs[b][1] < pairs[i][1]) for i, b in enumerate(back))


def test_recall_of_fuzzy_passages(spark):
    """Planted passages with differing words, against the pairs that lie within the operator's definition."""
    rng = random.Random(3)
    text = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], collections.defaultdict(list)
    for n, step in ((56, 7), (100, 6), (70, 7), (64, 8), (200, 10)):
        for _ in range(40):
            a = text(n)
            b = [w if k % step else f"s{w}" for k, w in enumerate(a, 1)]
            planted[n, step].append((len(rows), len(rows) + 1))
            rows += [text(20) + a + text(20), text(30) + b + text(10)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(2)
    found = {(r["first_id"], r["doc_id"]) for r in substring_dedup.passages(df).collect()}
    found |= {(b, a) for a, b in found}
    for kind, pairs in planted.items():
        assert sum(p in found for p in pairs) >= 0.85 * len(pairs), kind
    everything = [p for pairs in planted.values() for p in pairs]
    assert sum(p in found for p in everything) >= 0.9 * len(everything)


def test_large_counts_keep_their_value():
    answer = np.zeros(2, katz.NUMBERED)
    answer["number"], answer["count"] = [3, 2**40], [2 * 10**10, 2**50]
    got = packed.unpack(packed.pack(answer), katz.NUMBERED)
    assert got["number"].tolist() == [3, 2**40] and got["count"].tolist() == [2 * 10**10, 2**50]


def test_damaged_media(spark):
    good = jpeg.encode([b"some text " * 90])[0]
    media = [(0, good), (1, None), (2, b""), (3, b"GIF89a"), (4, good[:40]), (5, good[: len(good) // 2]), (6, b"\xff\xd8\xff"), (7, good)]
    rows = {r["doc_id"]: r for r in jpeg.media_features(spark.createDataFrame(media, "doc_id long, media binary")).collect()}
    assert sorted(rows) == list(range(8)) and rows[0]["n_bytes"] == 900 and rows[0]["error"] is None
    assert rows[0]["feature"] == rows[7]["feature"]
    for k in range(1, 7):
        assert rows[k]["error"] and rows[k]["feature"] is None and rows[k]["media_bytes"] == (None if k == 1 else len(media[k][1]))


def test_commits_that_broke_off_do_not_count(spark, tmp_path):
    counts = spark.createDataFrame([(1, "a", "en", 5, "v"), (2, None, None, 7, "v")], "doc_id long, source string, lang string, n_tokens long, tokenizer string")
    ledger = token_rollup.TokenRollup(spark, f"{tmp_path}/ledger")
    ledger.commit("one", token_rollup.inserts(counts))
    ledger.commit("two", token_rollup.inserts(counts))
    (tmp_path / "ledger" / "batch=two" / "_SUCCESS").unlink()
    assert ledger.totals().agg(F.sum("n_tokens")).first()[0] == 12
    assert ledger.commit("two", token_rollup.inserts(counts))  # written anew
    assert ledger.totals().agg(F.sum("n_tokens")).first()[0] == 24
    cube = {(r["source"], r["lang"], r["tokenizer"], r["level"]): (r["n_docs"], r["n_tokens"]) for r in ledger.rollup().collect()}
    assert cube[None, None, None, 7] == (4, 24) and cube["a", None, None, 3] == (2, 10) and cube[None, None, "v", 6] == (4, 24) and cube[None, None, "v", 0] == (2, 14)


def test_shards_come_from_the_tree(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, shards=8)
    taken = collections.Counter()
    for r in mixing.mixing_digests(mixed).collect():
        assert r["taken"] == r["size"] * len(r["shards"]) and all(0 <= s < 8 for s in r["shards"])
        taken.update(r["shards"])
    assert len(taken) == 8 and max(taken.values()) < sum(taken.values()) / 4


def pipeline_rows():
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["der", "sch", "ung", "und", "ä"], "es": ["que", "ción", "los", "ñ", "ar"], "fr": ["eau", "les", "eux", "ê", "ç"]}
    word = lambda x: "".join(rng.choice(parts[x]) for _ in range(rng.randint(2, 5)))
    rows = [(i, " ".join(word(x) for _ in range(rng.randint(60, 90))), x, f"s{i % 4}", i) for i, x in enumerate(list(parts) * 15)]
    text = rows[8][1].split()
    near = " ".join(["neu", *text[1:]])
    rows += [(100, rows[3][1], "fr", "s1", 1), (101, rows[3][1], "fr", None, 1), (102, near, "en", "s2", 1), (103, None, None, None, None), (104, "", "en", "s0", 0), (105, "0x8f 77 @@@ 93 $$ 44 " * 20, None, "s0", 1), (None, rows[5][1], "de", "s1", 1)]
    return rows


def test_pipeline(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash long, src string, block int"
    rows = pipeline_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).repartition(3)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    corpus_pipeline.prepare(spark)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), schema)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    language, exact, near, mixed = kept
    clean = {r[0] for r in rows[:60]}
    assert {d for d, _ in language} >= clean and not {103, 104, 105} & {d for d, _ in language}
    assert sorted(t for _, t in exact) == sorted({t for _, t in language})
    assert 101 in {d for d, _ in exact} and not {3, 100, None} & {d for d, _ in exact}
    assert {d for d, _ in exact} - {d for d, _ in near} == {102}
    assert {d for d, _ in mixed} <= {d for d, _ in near} and max(collections.Counter(mixed).values()) <= 3
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces) >= len(mixed)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, "").schema) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, "")
    assert docs.count() == 0
