"""Null ids, ties and clashing columns: defined results, no crash."""

import pytest

from bytegrove.llm import exact_dedup, jpeg, katz, language_id, mixing, near_dedup, packing, substring_dedup, token_orc, token_rollup
from bytegrove.llm.common import keep_rows, vocabulary

VOCAB = vocabulary("word_bpe_49k.json")
LONG = " ".join(f"w{k}" for k in range(60))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, LONG, None, None), (None, LONG, None, None), (5, LONG, "en", "s"), (5, "other text", "en", "s"), (6, None, None, "s"), (-7, "", "xx", ""), (2**62, "a b", "en", "s")]
    names = "doc_id long, text string, lang string, source string, "
    clash = "rid long, src string, size long, hash long, block int, kept boolean, `end` string, label string, fp string, n long, key string, `__doc` long, `__key` long"
    return spark.createDataFrame([(*r, *[None] * 11, 8, 9) for r in rows], names + clash).repartition(2)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d or 0))


ALL = [None, None, -7, 5, 5, 6, 2**62]


def test_every_row_has_a_result(spark, odd, tmp_path):
    token_orc.write_token_orc(odd, f"{tmp_path}/ids", VOCAB, 3)
    digests = token_orc.token_digests(token_orc.read_token_orc(spark, f"{tmp_path}/ids")).orderBy("start").collect()
    assert [r["doc_id"] for r in digests] == ALL  # nulls come first
    assert ids(mixing.mixing_digests(mixing.mix(odd)).collect()) == ALL
    assert ids(packing.packing_digests(packing.pack(odd, VOCAB)).collect()) == ALL
    assert ids(katz.katz_scores(odd).collect()) == ALL
    assert ids(jpeg.media_features(jpeg.media_column(odd)).collect()) == ALL
    model = language_id.fit(odd)
    assert len(language_id.identify(language_id.document_evidence(odd), model).collect()) == 7
    assert sum(r["n_docs"] for r in token_rollup.TokenRollup(spark, f"{tmp_path}/none").totals().collect()) == 0
    assert token_rollup.count_tokens(odd, VOCAB, "v").count() == 7


def test_copies(odd):
    exact = exact_dedup.exact_groups(odd).collect()
    assert ids(exact) == ALL
    same = [r for r in exact if r["group_size"] == 3]
    assert [r["kept"] for r in sorted(same, key=lambda r: r["doc_id"] or 0)].count(True) == 1 and {r["keep_id"] for r in same} == {5}
    near = near_dedup.near_classes(odd).collect()
    assert ids(near) == ALL and sum(r["kept"] for r in near) == 4
    assert {r["class_id"] for r in near if r["group_size"] == 3} == {5}
    assert {(r["doc_id"], r["first_id"]) for r in substring_dedup.passages(odd).collect()} <= {(a, b) for a in (None, 5) for b in (None, 5)}
    left = keep_rows(odd, near_dedup.near_classes(odd).select("doc_id", "hash", "kept"))
    assert left.columns == odd.columns and ids(left.collect()) == [-7, 5, 5, 2**62] and all(r["__doc"] == 8 and r["__key"] == 9 for r in left.collect())


def test_a_mix_keeps_clashing_columns(odd):
    mixed = mixing.mixed_documents(odd, mixing.mix(odd))
    assert mixed.columns == odd.columns
    mixed.collect()
