"""Batched edit distance."""

import random

from pyspark.sql import functions as F

from tessera.functions import editdistance as ED


def _plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_batched_distances_are_levenshteins(spark, monkeypatch):
    r = random.Random(5)
    pairs = [("", ""), ("a", ""), ("é漢😀", "漢é")]
    for n in (1, 2, 63, 64, 65, 128, 129, 200):
        for k in (1, 3, 64, 65, 130):
            for letters in ("ab", "abcdefgh ", "é漢😀ab"):
                a = "".join(r.choices(letters, k=n))
                pairs += [(a, "".join(r.choices(letters, k=k))), (a, a[1:k] + "x" + a[k:])]
    want = [_plain(*p) for p in pairs]
    assert ED.distances(*map(list, zip(*pairs))).tolist() == want and ED.distances([], []).tolist() == []
    monkeypatch.setattr(ED, "TABLE", 1)  # a pair at a time
    assert ED.distances(*map(list, zip(*pairs))).tolist() == want
    long = "SELECT a FROM t " * 80  # beyond LONGEST, so pair by pair
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None), (None, None), (long, long + "x"), (long, "a")], "a string, b string")
    both = rows.select(ED.edit_distance(F.col("a"), F.col("b")), F.levenshtein("a", "b")).collect()
    assert [x[0] for x in both] == [x[1] for x in both] and both[-1][0] == len(long) - 1
