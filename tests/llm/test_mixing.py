"""Mixing: water-filling against a plain solver, samples against a sort, odd rows and skew."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.mixing import mixed, mixture, word_count


def _plain(rows, weights=(5, 2, 1), share=150, epochs=2, seed="mix"):
    """(doc_id, size, source_size, target, taken) by hand: clamp and share out in fractions, then sort by hash."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    total = defaultdict(int)
    for _, s, n in sized:
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    wanted, clamped = Fraction(share * sum(total.values()), 100), {}
    while True:
        rest = [s for s in names if s not in clamped]
        left = wanted - sum(clamped.values())
        if not rest:
            break
        level = left / sum(weight[s] for s in rest)
        over = {s: Fraction(epochs * total[s]) for s in rest if level * weight[s] > epochs * total[s]}
        if not over:
            break
        clamped |= over
    target = {s: clamped.get(s, level * weight[s] if rest else None) for s in names}

    def key(i):
        return 0 if i is None else int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16)

    out = []
    for s in names:
        own = [(key(i), i, n) for i, t, n in sized if t == s]
        words = int(target[s])
        whole, left = divmod(words, total[s]) if total[s] else (0, 0)
        for k in sorted({k for k, _, _ in own}):
            group = [(i, n) for j, i, n in own if j == k]
            there = sum(n for _, n in group)
            now = min(left, there)
            out += [(i, n, total[s], float(target[s]), whole * n + (n * now // there if there else 0)) for i, n in group]
            left -= now
    return sorted(out, key=repr)


def _got(df, **kw):
    return sorted((tuple(r) for r in mixture(df, **kw).collect()), key=repr)


SCHEMA = "doc_id long, source string, text string"


@pytest.mark.parametrize("kw", [{}, {"weights": (1,), "share_percent": 30}, {"weights": (1, 50), "share_percent": 290, "epochs": 3},
                                {"share_percent": 250, "seed": "other"}])
def test_mixture_equals_a_plain_solver(spark, kw):
    rng = random.Random(str(kw))
    rows = []
    for source, n in (("a", 400), ("b", 30), ("ab", 3), (None, 50), ("é", 120), ("B", 1), ("\U0001F600", 9), ("empty", 4)):
        for _ in range(n):
            words = 0 if source == "empty" else int(rng.paretovariate(1.2))
            rows.append((len(rows), source, " ".join("w" for _ in range(words)) if words else rng.choice([None, "", " \n"])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    names = {"share_percent": "share"}
    want = _plain(rows, **{names.get(k, k): v for k, v in kw.items()})
    got = _got(df, **kw)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert got == _got(df.repartition(3), **kw)                       # reruns agree
    assert all(r[4] <= kw.get("epochs", 2) * r[1] for r in got)


def test_word_counts(spark):
    texts = ["", None, " ", "a", " a ", "a\x0bb\x0cc\rd\te\nf g", "a\xa0b c", "x" * 100_000, "a " * 50_000, "\x00 \x1f"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.n for r in df.select("k", word_count(F.col("t")).alias("n")).collect()}
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}


def test_odd_rows(spark, messy, messy_rows, nothing):
    got = _got(messy)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in _plain([(i, "s", t) for i, t in messy_rows])]
    assert got == _got(messy.withColumn("size", F.lit("?")).withColumn("whole", F.lit(0)))
    assert mixture(nothing).count() == 0 and mixed(nothing).count() == 0
    blank = messy.withColumn("text", F.lit(" "))
    assert {tuple(r)[1:] for r in mixture(blank).collect()} == {(0, 0, 0.0, 0)} and mixed(blank).count() == 0


def test_a_source_with_most_rows_and_one_long_document(spark):
    rows = [(k, "hot", "a b c") for k in range(5000)] + [(9000 + k, "s", "x") for k in range(10)] + [(9999, "t", "y " * 9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = _got(df)
    assert got == _plain(rows)
    by = defaultdict(int)
    source = {i: s for i, s, _ in rows}
    for i, _, _, target, taken in got:
        by[source[i], target] += taken
    assert all(n == int(target) for (_, target), n in by.items())


def test_the_mix_has_what_the_plan_says(spark, docs):
    words = defaultdict(int)
    for r in mixed(docs).select("doc_id", "text", "mix_copy").collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    plan = {r.doc_id: r.taken for r in mixture(docs).collect()}
    assert {i: n for i, n in plan.items() if n} == dict(words)
    assert mixed(docs).columns == [*docs.columns, "mix_copy"]
    with pytest.raises(ValueError):
        mixed(docs, copy="text")


def test_sums_per_source_and_digit_are_bounded(spark):
    """What a source has in a round: a sum per digit of the key, whatever its rows."""
    narrow = mixing._narrow(spark.range(30_000).selectExpr("id AS doc_id", "'s' AS source", "'a b' AS text"), "mix")
    digits = narrow.select(F.shiftright("key", mixing.KEY_BITS - mixing.DIGIT_BITS).alias("d")).distinct().count()
    assert digits <= 1 << mixing.DIGIT_BITS and mixing.KEY_BITS % mixing.DIGIT_BITS == 0
