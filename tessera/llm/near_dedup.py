"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (64-bit hashes).
   Equal sets collapse to one representative, so copies cost nothing further.
2. Banded MinHash keys propose candidates. Representatives that share a key are
   chained to the smallest one of that key, and the components of these chains
   (plain ids) are the candidate clusters: every candidate pair lies in one.
3. A cluster is compared in blocks of bounded size. Within a block, only pairs
   that share a band key are candidates; their signatures are compared in
   batches and a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold falls below the miss probability. Survivors
   are verified on the full sets. A pair already joined by verified links in the
   block needs no check of its own: it can't change the components.
4. The verified links' components name the groups.

A cluster beyond ``WIDE`` representatives (boilerplate can chain many groups) is
compared per band key instead, each pair under the first key it shares, so work
follows the keys' sizes and not the square of the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_hash, written
from .components import connected_components

SIGNATURE = 128      # hash functions in a signature
BATCH = 16           # signature positions compared before each posterior check
MISS = 1e-6          # chance of missing a pair at the threshold, by the bands and by the pruning
BLOCK_ROWS = 512     # representatives in a block
BLOCK_SHINGLES = 1_000_000
WIDE = 8192

_RNG = np.random.default_rng(20_240)
_MUL = _RNG.integers(0, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SIGNATURE, dtype=np.uint32)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def band_shape(threshold: float, miss: float = MISS) -> tuple[int, int]:
    """``(bands, rows)``: the longest rows whose bands reach the miss probability within the signature."""
    best = None
    for rows in range(1, 17):
        bands = math.ceil(math.log(miss) / math.log1p(-threshold**rows))
        if bands * rows <= SIGNATURE:
            best = (bands, rows)
    if best is None:
        raise ValueError(f"a threshold of {threshold} needs a signature of more than {SIGNATURE} functions")
    return best


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each checked prefix of the signature, the fewest equal positions that keep a pair.

    With a uniform prior, similarity given m of n equal positions is
    Beta(m+1, n-m+1), and P(S >= t) is the chance of at most m successes in n+1
    draws of probability t.
    """
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out.append(m)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are runs without ASCII white space after A-Z is lower-cased. A text of
    fewer words gives its whole sequence as one shingle, a text without words none.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = _mix(mixed * _FOLD + h[k:len(h) - size + 1 + k])
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (_mix(shingles) >> np.uint64(32)).astype(np.uint32)
    best = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = x[at:at + 2048, None] * _MUL + _ADD
        np.minimum(best, h.min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = sig[:bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = _mix(key * _FOLD + part[:, r])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], words: int, shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, mark, keys = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), words)
            n.append(len(s))
            mark.append(xxhash.xxh3_128_digest(s.tobytes()))
            keys.append(band_keys(signature(s), *shape) if len(s) else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32),
            pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), lists],
            names=["doc_id", "text_hash", "n_shingles", "mark", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()),
             pa.array([signature(s).tobytes() for s in sets], pa.binary())],
            names=["rep", "shingles", "sig"])


def _links_in_block(table: pa.Table, percent: int, shape: tuple[int, int], least: list[int]) -> pa.Table:
    """Verified links of one pair of blocks, none for a pair that earlier links join."""
    low, high, band = table["low"][0].as_py(), table["high"][0].as_py(), table["band"][0].as_py()
    blk, rep = table["blk"].to_numpy(), table["rep"].to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]
    sigs = np.frombuffer(b"".join(x.as_py() for x in table["sig"]), np.uint32).reshape(-1, SIGNATURE)
    size = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(blk == low), np.flatnonzero(blk == high)
    bands, rows = shape
    found_a, found_b, found_m = [], [], []
    for at, i in enumerate(left):
        others = right[at + 1:] if low == high else right
        # sets whose sizes alone rule the threshold out
        others = others[(100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))]
        if not len(others):
            continue
        same = sigs[others] == sigs[i]
        shared = same[:, :bands * rows].reshape(-1, bands, rows).all(axis=2)
        keep = shared.any(axis=1)
        if band >= 0:
            keep &= shared.argmax(axis=1) == band
        others, same = others[keep], same[keep]
        matches = np.zeros(len(others), np.int64)
        for k, need in enumerate(least):
            # the bands come first in a signature, so start at its far end
            end = SIGNATURE - k * BATCH
            matches += same[:, end - BATCH:end].sum(axis=1)
            on = matches >= need
            others, same, matches = others[on], same[on], matches[on]
        found_a.append(np.full(len(others), i))
        found_b.append(others)
        found_m.append(matches)
    a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
    m = np.concatenate(found_m) if found_m else np.empty(0, np.int64)
    root = list(range(len(rep)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out_a, out_b = [], []
    for k in np.argsort(-m, kind="stable"):
        i, j = int(a[k]), int(b[k])
        x, y = find(i), find(j)
        if x == y:
            continue
        small, large = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
        where = np.searchsorted(large, small)
        where[where == len(large)] = 0
        common = int((large[where] == small).sum())
        if 100 * common >= percent * (len(small) + len(large) - common):
            root[max(x, y)] = min(x, y)
            out_a.append(rep[i])
            out_b.append(rep[j])
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by ``100 * |A and B| >= percent * |A or B|`` on word shingles.

    Returns one row per row of ``docs``: ``doc_id``, ``n_shingles`` (size of the
    set), ``component_id`` (smallest doc_id reachable over links, itself
    included), ``kept`` (``doc_id = component_id``) and ``text_hash``.

    A null or empty text, or one of white space, has an empty set and links with
    nothing. A row without doc_id can't be named: its component_id is null and
    it is kept. Repeated rows each give a row with the same result; rows that
    give one doc_id different texts count as one node with several sets. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    shape = band_shape(percent / 100)
    least = least_matches(percent / 100)
    rows = id_text(docs).withColumn("text_hash", text_hash())
    signed = written(rows.mapInArrow(
        lambda it: _signed(it, words, shape), "doc_id long, text_hash long, n_shingles long, mark binary, keys array<long>"), "signed")

    reps = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("mark")
                   .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"),
                        F.first("n_shingles").alias("n_shingles")), "reps")
    keyed = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = written(keyed.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1"),
                     "shared")
    chained = (keyed.join(shared, "key").where("rep <> first")
               .select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
    clusters = written(connected_components(chained)
                       .join(reps.groupBy(F.col("rep").alias("id")).agg(F.sum("n_shingles").alias("n_shingles")), "id")
                       .select(F.col("id").alias("rep"), F.col("component").alias("cluster"), "n_shingles"), "clusters")

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"))
    sized = clusters.join(sizes, "cluster")
    groups = sized.where(F.col("members") <= WIDE).select(
        "rep", F.col("cluster").alias("grp"), F.lit(-1).alias("band"), "members", "total")
    wide = sized.where(F.col("members") > WIDE).select("rep", "n_shingles")
    if not wide.isEmpty():
        keys = wide.join(keyed, "rep").join(shared.select("key"), "key")
        key_sizes = keys.groupBy("key").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total"))
        groups = groups.unionByName(keys.join(key_sizes, "key").select(
            "rep", F.col("key").alias("grp"), "band", "members", "total"))
    groups = groups.withColumn("blocks", F.greatest(
        F.ceil(F.col("members") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int"))
    placed = groups.withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = placed.select("rep", "grp", "band", "blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pairs = pairs.select("rep", "grp", "band", "blk", F.least("blk", "o").alias("low"),
                         F.greatest("blk", "o").alias("high"))

    # two rows may give one doc_id different texts: each set then stands for that id
    texts = rows.select("doc_id", "text").join(clusters.select(F.col("rep").alias("doc_id")), "doc_id").dropDuplicates(["doc_id", "text"])
    sets = texts.mapInArrow(lambda it: _sets(it, words), "rep long, shingles binary, sig binary")
    links = (pairs.join(sets, "rep").groupBy("grp", "band", "low", "high")
             .applyInArrow(lambda t: _links_in_block(t, percent, shape, least), "a long, b long"))
    named = connected_components(links)

    marks = (reps.select("mark", "rep").join(named.select(F.col("id").alias("rep"), "component"), "rep", "left")
             .select("mark", F.coalesce("component", "rep").alias("component")))
    own = signed.drop("keys")
    grouped = own.where("n_shingles > 0 and doc_id is not null").join(marks, "mark").select(
        "doc_id", "n_shingles", F.col("component").alias("component_id"), "text_hash")
    alone = own.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return grouped.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept, "text_hash")
