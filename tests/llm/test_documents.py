"""Quality ranking, fingerprints, exact duplicates and the whole pipeline."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import fingerprints, quality
from tessera.llm.exact_dedup import exact_duplicates

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in entry.queries()["op1_quality_ranking"](spark, SF).collect()}
    held = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good = [got[r.doc_id].score for r in held if r.quality == 1]
    bad = [got[r.doc_id].score for r in held if r.quality == 0]
    assert good and bad
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_pairs_use_every_row_of_the_smaller_side():
    w, l = quality.preference_pairs(10, 3, 4)
    assert len(w) == 12 and set(l) == {0, 1, 2} and set(w) == set(range(10))
    w, l = quality.preference_pairs(2, 5, 4)
    assert len(l) == 8 and set(w) == {0, 1}


def test_fit_equals_plain_gradient_descent():
    """The penalised loss of the pairs, one by one in the simplest way, has its minimum where the fit says."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, quality.WIDTH))
    y = (x[:, 2] - x[:, 5] + rng.normal(size=50) > 0).astype(int)
    ranking = quality.fit_ranking(x, y)
    z = [np.concatenate([t, t * t]) for t in np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)]
    good, bad = [a for a, b in zip(z, y) if b == 1], [a for a, b in zip(z, y) if b == 0]
    gaps = np.array([good[w] - bad[l] for w, l in zip(*quality.preference_pairs(len(good), len(bad)))])

    def loss(v):
        return np.mean([math.log1p(math.exp(-g @ v)) for g in gaps]) + quality.PENALTY / 2 * (v @ v)

    v, before = np.zeros(2 * quality.WIDTH), np.zeros(2 * quality.WIDTH)
    rate = 1 / (np.linalg.eigvalsh(gaps.T @ gaps / len(gaps))[-1] / 4 + quality.PENALTY)
    for k in range(6000):
        at = v + k / (k + 3) * (v - before)
        before, v = v, at + rate * (gaps.T @ (1 / (1 + np.exp(gaps @ at))) / len(gaps) - quality.PENALTY * at)
    assert np.allclose(ranking.weights, v, atol=1e-5)
    assert all(loss(ranking.weights) <= loss(ranking.weights + 0.01 * rng.normal(size=len(v))) for _ in range(50))
    strength = np.array([a @ v for a in z])
    order, cut = np.sort(strength), (y == 0).sum()
    want = 1 / (1 + np.exp((order[cut - 1] + order[cut]) / 2 - strength))
    assert np.allclose(ranking.score(x), want, atol=1e-4)


def test_the_sample_is_cut_off_by_hash(spark):
    """At most the asked rows are in the sample, and it is the rows of the smallest hashes whatever the partitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = quality.learned(docs, labels, rows=50)
    b = quality.learned(docs.repartition(11), labels, rows=50)
    assert np.allclose(a.weights, b.weights, atol=1e-9) and a.weights.any()


def test_threshold_is_the_quantile_of_label_0():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.WIDTH))
    y = (x[:, 3] + 0.1 * rng.normal(size=400) > -1).astype(int)
    ranking = quality.fit_ranking(x, y)
    assert (ranking.score(x) < 0.5).sum() == (y == 0).sum()
    one = quality.fit_ranking(x, np.ones(400))
    assert (one.score(x) == 0.5).all()
    assert quality.fit_ranking(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_scores_need_neither_labels_nor_names(spark, docs):
    ranking = quality.learned(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    a = {r.doc_id: r.score for r in quality.scored(docs, ranking).collect()}
    moved = docs.selectExpr("doc_id + 5 AS doc_id", "text", "'xx' AS lang", "'s' AS source")
    assert {r.doc_id - 5: r.score for r in quality.scored(moved, ranking).collect()} == a


def _plain_level(symbols, mix):
    mask, k1, k2 = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    runs = [(s, len(list(own))) for s, own in itertools.groupby(symbols)]
    symbols = [mix((s + n * k2) & mask) if n > 1 else s for s, n in runs]
    labels = symbols
    for _ in range(3):
        tossed = []
        for at, label in enumerate(labels):
            left = labels[at - 1] if at else ~label & mask
            bit = next(b for b in range(64) if (label ^ left) >> b & 1)
            tossed.append(2 * bit + (label >> bit & 1))
        labels = tossed
    starts = [0] + [k for k in range(2, len(labels) - 1) if labels[k - 1] > labels[k] < labels[k + 1]]
    phrases = [symbols[a:b] for a, b in zip(starts, [*starts[1:], len(symbols)])]
    return [mix(sum(mix((s * k1 + p * k2 + k1) & mask) for p, s in enumerate(phrase)) & mask) for phrase in phrases]


def _plain_sketch(text):
    """The same parse symbol by symbol: runs, three tosses, cuts at local minima, 64 slots of smallest names."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 29)

    slots = [0xFFFFFFFF] * 64
    symbols = [mix(((ord(c) + 1) * 0x9E3779B97F4A7C15) & mask) for c in text]
    for level in range(1, fingerprints.LEVELS + 1):
        if not symbols:
            break
        symbols = _plain_level(symbols, mix)
        alone = len(symbols) == 1
        for name in symbols if alone or level >= fingerprints.FROM_LEVEL else []:
            slots[name % 64] = min(slots[name % 64], name >> 32)
        if alone:
            break
    return slots


def _as_slots(fingerprint):
    return [int(fingerprint[k:k + 8], 16) for k in range(0, 512, 8)]


def _plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if x != 0xFFFFFFFF or y != 0xFFFFFFFF]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprint_rows(spark, docs):
    """Everything follows from the returned fingerprints and a parse that goes symbol by symbol."""
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs.repartition(6)).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        changed = text[:len(text) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == _plain_likeness(_as_slots(r.fingerprint), _as_slots(r.edited_fingerprint))
        assert r.near_next == _plain_likeness(_as_slots(r.fingerprint), _as_slots(got[rows[(k + 1) % len(rows)][0]].fingerprint))
        if len(text) < 3000:
            assert _as_slots(r.fingerprint) == _plain_sketch(text) and _as_slots(r.edited_fingerprint) == _plain_sketch(changed)
    long = [r for r in got.values() if r.n_chars > 1500]
    assert np.median([r.near_edited for r in long]) > 0.4 > 0.1 > np.median([r.near_next for r in long])


def test_short_texts_have_fingerprints_of_their_own():
    texts = [str(k) for k in range(20_000)]
    assert len(set(fingerprints.as_text(fingerprints.sketches(texts)))) == len(texts)


def test_fingerprints_dont_depend_on_neighbours(docs):
    texts = [r.text for r in docs.limit(30).collect()] + ["", "a", "aa", "ab", "aba", "x" * 1000, "é" * 3]
    together = fingerprints.sketches(texts)
    assert all((fingerprints.sketches([t])[0] == together[k]).all() for k, t in enumerate(texts))
    assert (together[texts.index("")] == 0xFFFFFFFF).all() and not (together[texts.index("a")] == 0xFFFFFFFF).all()


def test_equal_substrings_parse_alike_at_any_offset(docs):
    long = [r.text for r in docs.collect() if len(r.text) > 3000]
    a = fingerprints.sketches(long)
    b = fingerprints.sketches(["some other beginning, " + t for t in long])
    # a text that repeats one passage has few phrases to share
    assert fingerprints.likeness(a, b).min() > 0.5 and np.median(fingerprints.likeness(a, b)) > 0.9


def test_exact_groups(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for prefix in (1, 256):
        for r in exact_duplicates(docs, prefix).collect():
            same = [i for i, t in texts.items() if t == texts[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))


@pytest.mark.parametrize("name", ["op9_exact_duplicates", "op11_mixing"])
def test_no_python_in_the_native_plan(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_drops_copies_and_keeps_clean_documents(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = source
    clean = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == source.columns
        assert set(after) <= set(before)
        if name == "quality":
            assert sum(i in after for i in clean) > 0.97 * len(clean)
        if name == "exact":
            assert len(after) == len(set(before.values()))
        if name == "secrets":
            assert set(after) == set(before)
            assert not any("AKIA" in t or "password=" in t for t in after.values())
        else:
            assert all(before[i] == t for i, t in after.items())
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_cut_and_moments_come_from_all_labelled_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ranking = quality.learned(docs, labels, rows=60)
    known = {}
    for r in labels.where("quality in (0, 1)").collect():
        known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    rows = [(quality.features(r.text or ""), known[r.doc_id]) for r in docs.collect() if r.doc_id in known]
    x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    assert len(x) > 60 and np.allclose(ranking.centre, x.mean(axis=0)) and np.allclose(ranking.spread, np.maximum(x.std(axis=0), 1e-6))
    order = np.sort(ranking.strength(x))
    cut = (y == 0).sum()
    assert ranking.threshold == pytest.approx((order[cut - 1] + order[cut]) / 2, abs=1e-9)


def test_value_at_a_rank(spark):
    values = np.concatenate([np.random.default_rng(1).normal(size=3000), [0.5] * 500, [1e9, -1e12]])
    table = spark.createDataFrame([(float(v),) for v in values], "s double")
    for rank in (0, 1, 1500, 2500, len(values) - 1):
        assert quality.value_at(table, rank) == np.sort(values)[rank]


@pytest.mark.parametrize("winners, losers", [(9, 9), (100, 3), (3, 100), (1, 1), (2, 5), (40, 30)])
def test_pairs_differ_and_use_every_row(winners, losers):
    w, l = quality.preference_pairs(winners, losers)
    assert len(set(zip(w, l))) == len(w) and set(w) == set(range(winners)) and set(l) == set(range(losers))
