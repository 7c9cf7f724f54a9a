"""Near-duplicate groups against brute force; components against union-find."""

import random
import re

import numpy as np
import pytest

from tessera.llm import near_dedup
from tessera.llm.components import connected_components
from tessera.llm.near_dedup import band_shape, least_matches, near_duplicates, shingle_set


def _smallest(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[i] = ({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words
                   else {tuple(w)} if w else set())
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                links.append((a, b))
    return {i: (len(sets[i]), c) for i, c in _smallest(ids, links).items()}


@pytest.fixture(scope="module")
def copies(spark, docs):
    """The small table and a chain of edited copies, whose ends aren't linked to each other."""
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for family in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for step in range(25):
            rows.append((1000 + family * 100 + step, " ".join(words)))
            words[rng.randrange(120)] = f"x{rng.randrange(5000)}"
            if step % 3 == 0:
                words[rng.randrange(120)] = f"y{rng.randrange(5000)}"
    return rows


def _found(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, **kwargs).collect()}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, copies, words, percent):
    assert _found(spark, copies, words=words, percent=percent) == _brute(copies, words, percent)


def test_blocks_and_wide_clusters_give_the_same_groups(spark, copies, monkeypatch):
    want = _brute(copies, 3, 85)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    assert _found(spark, copies, words=3, percent=85) == want
    monkeypatch.setattr(near_dedup, "WIDE", 3)
    assert _found(spark, copies, words=3, percent=85) == want


def test_chains_in_small_blocks(spark, monkeypatch):
    """Chains whose ends aren't linked to each other, in blocks of three, against brute force."""
    rng = random.Random(11)
    rows = []
    for family in range(3):
        words = [f"f{family}w{k}" for k in range(80)]
        for step in range(60):
            rows.append((family * 1000 + rng.randrange(900), " ".join(words)))
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
    rows = list(dict(rows).items())
    want = _brute(rows, 3, 85)
    assert _found(spark, rows, words=3, percent=85) == want
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    assert _found(spark, rows, words=3, percent=85) == want
    monkeypatch.setattr(near_dedup, "WIDE", 5)
    assert _found(spark, rows, words=3, percent=85) == want


def test_a_threshold_out_of_reach_is_an_error():
    with pytest.raises(ValueError):
        band_shape(0.05)


def test_bands_and_pruning_meet_the_miss_probability():
    for t in (0.8, 0.85, 0.9):
        bands, rows = band_shape(t)
        assert bands * rows <= near_dedup.SIGNATURE and (1 - t**rows) ** bands <= near_dedup.MISS
    # pruning: a pair at the threshold is dropped about as often as the posterior bound allows
    rng = np.random.default_rng(1)
    equal = rng.random((200_000, near_dedup.SIGNATURE)) < 0.85
    dropped = np.zeros(len(equal), bool)
    for k, need in enumerate(least_matches(0.85)):
        dropped |= equal[:, :(k + 1) * near_dedup.BATCH].sum(axis=1) < need
    assert dropped.mean() < 1e-4


def test_signatures_estimate_similarity():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    a = shingle_set(" ".join(words), 1)
    b = shingle_set(" ".join(words[300:] + [f"v{k}" for k in range(300)]), 1)
    got = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    ids = list(range(400))
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(k, k + 1) for k in range(200, 260)]
    links += [(300, k) for k in range(301, 380)] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = _smallest(ids, links)
    assert got == {i: want[i] for i in got} and {i for a, b in links if a != b for i in (a, b)} == set(got)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
