"""Nulls, empty and long texts, repeated rows, ties, clashing columns and empty tables, for every operator and stage."""

from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm.exact_dedup import exact_duplicates
from tessera.llm.fingerprints import fingerprints
from tessera.llm.license_scan import license_digests
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import packed_sequences
from tessera.llm.pii import personal_digests
from tessera.llm.quality import quality_scores
from tessera.llm.secret_scan import secret_digests
from tessera.llm.sentencepiece_codec import piece_digests
from tessera.llm.token_files import token_digests


def _quality(df):
    spark = df.sparkSession
    labels = spark.createDataFrame([(1, 1), (8, 0), (6, 1), (9, 0), (None, 1), (4, None), (2, 1), (2, 0)],
                                   "doc_id long, quality int")
    return quality_scores(df, labels)


PER_ROW = {
    "quality": _quality, "near": near_duplicates, "secrets": secret_digests, "licenses": license_digests,
    "tokens": lambda df: token_digests(df, df.sparkSession), "personal": personal_digests, "pieces": piece_digests,
    "fingerprints": fingerprints, "exact": exact_duplicates,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(name, messy, messy_rows):
    got = Counter(r.doc_id for r in PER_ROW[name](messy).collect())
    assert got == Counter(i for i, _ in messy_rows)


@pytest.mark.parametrize("name", [*PER_ROW, "packing"])
def test_empty_table(name, nothing):
    operator = PER_ROW.get(name, packed_sequences)
    assert operator(nothing).count() == 0


def test_same_result_for_repeated_rows(messy):
    for name in ("near", "secrets", "licenses", "personal", "pieces", "exact"):
        rows = [tuple(r) for r in PER_ROW[name](messy).where("doc_id = 2").collect()]
        assert len(rows) == 2 and rows[0] == rows[1], name


def test_null_text_is_empty_text(messy):
    for name, keep in (("secrets", None), ("licenses", None), ("personal", None), ("pieces", None), ("fingerprints", 2)):
        a, b = (PER_ROW[name](messy).where(f"doc_id = {i}").first() for i in (3, 4))
        assert tuple(a)[1:keep] == tuple(b)[1:keep], name


def test_exact_rules(messy):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(messy).collect()}
    assert {(1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False)} <= rows
    assert {(3, 4, 3, False), (4, 4, 3, True)} <= rows       # null equals empty
    assert (None, None, 1, True) in rows and (11, 11, 1, True) in rows


def test_near_rules(messy):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(messy, words=3, percent=85).collect()}
    assert {(1, 13, 1, True), (2, 13, 1, False), (4, 0, 4, True), (5, 0, 5, True), (8, 1, 8, True)} <= rows
    assert any(r[0] == 7 and r[2] == 6 and not r[3] for r in rows)
    assert all(r[2] is None and r[3] for r in rows if r[0] is None)


def test_packing_covers_every_row(messy, messy_rows):
    got = packed_sequences(messy).collect()
    ends = Counter((p.doc_id, p.doc_tokens) for p in got if p.start + p.length == p.doc_tokens)
    assert sum(ends.values()) == len(messy_rows)
    assert ends[4, 1] == 1 and ends[3, 1] == 1               # an empty text is its end id


@pytest.mark.parametrize("stage", dict(corpus_pipeline.STAGES))
def test_stages_keep_columns(stage, spark, messy, nothing):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, messy, "/root/testdata/sf0.001")
    if stage == "packing":
        assert out.columns[:3] == ["doc_id", "start", "length"]
        assert run(spark, nothing, "/root/testdata/sf0.001").count() == 0
        return
    assert out.columns == messy.columns
    out.collect()
    empty = run(spark, nothing, "/root/testdata/sf0.001")
    assert empty.columns == messy.columns and empty.count() == 0


def test_exact_stage_leaves_one_row_of_each_text(spark, messy, messy_rows):
    kept = dict(corpus_pipeline.STAGES)["exact"](spark, messy, "").collect()
    texts = Counter(r.text or "" for r in kept)
    assert set(texts) == {t or "" for _, t in messy_rows} and set(texts.values()) == {1}
