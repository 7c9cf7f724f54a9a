"""Properties of the corpus operators on the small driver tables."""

from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.plans.registry import views

SF = "/root/testdata/sf0.001"


def test_split_exact_disjoint_complete_sizes(spark):
    p = views(spark, SF).pairs
    s = C.split_exact(p)
    n = p.count()
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == n
    assert counts["val"] == int(n * 0.1) and counts["test"] == int(n * 0.1)
    assert s.select("pair_id").distinct().count() == n
    again = C.split_exact(p)
    assert s.join(again.withColumnRenamed("split", "s2"), "pair_id").where("split != s2").count() == 0


def test_sample_balanced_quota(spark):
    p = views(spark, SF).pairs
    got = {r.domain: r["count"] for r in C.sample_balanced(p, 10, "domain").groupBy("domain").count().collect()}
    cats = sorted(r.domain for r in p.select("domain").distinct().collect())
    want = {c: 10 // len(cats) + (1 if i < 10 % len(cats) else 0) for i, c in enumerate(cats)}
    assert got == want


def test_epoch_batches_cover_every_row_each_epoch(spark):
    p = views(spark, SF).pairs
    b = C.epoch_batches(p, 2, 8)
    n = p.count()
    per = {r.epoch: r["count"] for r in b.groupBy("epoch").count().collect()}
    assert per == {0: n, 1: n}
    assert b.agg(F.max("position")).first()[0] == n
