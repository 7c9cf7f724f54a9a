"""Quality classifier: Bradley-Terry ranking of documents by their features.

Preference pairs (a document labelled 1 beats one labelled 0) train a linear
score by logistic loss on the difference of their features. The decision
threshold is the quantile of the training scores at the share of label 0, and a
document's probability is the logistic of its distance to the threshold.

Features are computed for every document in the tasks. The weights are fitted on a
bounded sample of labelled rows (``FIT_ROWS``), whose features alone reach the
driver; the features' centre and spread, the share of label 0 and the threshold
come from all labelled rows by Spark's aggregates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, id_text, in_small_batches, written

FIT_ROWS = 20_000    # labelled rows in the fit, the ones with the smallest id hash
OPPONENTS = 8        # pairs that each of the rarer label's rows takes part in, or more to reach all of the other
BINS = 1024          # of a pass that looks for the value at a rank
PENALTY = 1e-2
STEPS = 40

_UPPER = re.compile(r"[A-Z]")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()-]")
_DIGIT = re.compile(r"[0-9]")
_SENTENCE = re.compile(r"[.!?](?:\s|\Z)")
_MARK = re.compile(r"[!|#*$%&~^=<>]")


def features(text: str) -> list[float]:
    """Shares and logarithms that describe form, not content; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * WIDTH
    chars = len(text)
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    lines = [line for line in text.split("\n") if line]
    pairs = max(n - 1, 1)
    distinct_pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    lower = sum(map(str.islower, words))
    shouted = sum(map(str.isupper, words))
    symbols = len(_SYMBOL.findall(text))
    marks = len(_MARK.findall(text))
    return [1.0, math.log1p(n), repeats / pairs, distinct / n, distinct_pairs / pairs, lower / n, shouted / n,
            symbols / chars, min(symbols / n, 3.0), min(marks / n, 3.0), (chars - n) / n / 10,
            len(_DIGIT.findall(text)) / chars, len(_UPPER.findall(text)) / chars, len(_SENTENCE.findall(text)) / n,
            text.count(",") / n, 1 - len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1))]


WIDTH = 17


@dataclass
class Ranking:
    """Standardised squares and features, their weights and the decision threshold."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return expanded(x, self.centre, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold, -500, 500)))


def expanded(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / spread, -6, 6)
    return np.concatenate([z, z * z], axis=1)


def preference_pairs(winners: int, losers: int, opponents: int = OPPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs, none twice: each member of the smaller side meets at least ``opponents`` of the other, which all take part."""
    few, many = min(winners, losers), max(winners, losers)
    each = min(max(opponents, -(-many // max(few, 1))), many)
    small = np.repeat(np.arange(few), each)
    large = np.arange(few * each) % max(many, 1)
    return (large, small) if winners >= losers else (small, large)


def fit_ranking(x: np.ndarray, label: np.ndarray, moments: tuple[np.ndarray, np.ndarray] | None = None) -> Ranking:
    """Newton's method for the penalised logistic loss of ``w . (winner - loser)``.

    ``moments`` are the features' mean and standard deviation, those of ``x`` unless given.
    Without rows of both labels there are no pairs: the weights are 0 and every
    document scores 0.5.
    """
    centre, spread = moments or ((x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH)))
    spread = np.maximum(spread, 1e-6)
    z = expanded(x, centre, spread)
    good, bad = z[label == 1], z[label == 0]
    weights = np.zeros(2 * WIDTH)
    if len(good) and len(bad):
        w, l = preference_pairs(len(good), len(bad))
        gap = good[w] - bad[l]
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(gap @ weights, -500, 500)))
            slope = gap.T @ (1 - p) / len(gap) - PENALTY * weights
            bend = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + PENALTY * np.eye(len(weights))
            step = np.linalg.solve(bend, slope)
            weights += step
            if np.abs(step).max() < 1e-8:
                break
    ranking = Ranking(centre, spread, weights, 0.0)
    if len(good) and len(bad):
        # the quantile at the share of label 0, halfway between the scores around it
        order = np.sort(ranking.strength(x))
        cut = len(bad)
        ranking.threshold = float((order[cut - 1] + order[cut]) / 2)
    return ranking


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x = [features(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(x, pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])


def _scores(batches: Iterator[pa.RecordBatch], ranking: Ranking) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ranking.score(x), pa.float64())],
                                         names=["doc_id", "score"])


def _accept(batches: Iterator[pa.RecordBatch], ranking: Ranking) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            x = np.array([features(t.as_py() or "") for t in part.column("text")], float).reshape(-1, WIDTH)
            yield part.filter(pa.array(ranking.score(x) >= 0.5))


def _strengths(batches: Iterator[pa.RecordBatch], ranking: Ranking) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(ranking.strength(x), pa.float64())], names=["s"])


def value_at(values: DataFrame, rank: int) -> float:
    """The exact value at a rank (0: the smallest) of column ``s``: counts by bins, then by bins of the bin it is in."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    while low < high:
        part = F.floor((F.col("s") - low) / (high - low) * BINS)
        bins = (values.where(F.col("s").between(low, high)).groupBy(F.least(part, F.lit(BINS - 1)).alias("bin"))
                .agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect())
        for found in sorted(bins, key=lambda r: r.bin):
            if rank < found.n:
                break
            rank -= found.n
        low, high = found.low, found.high
    return low


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features ``x`` of every row of ``docs``; features move afterwards, not texts."""
    return id_text(docs).mapInArrow(_features, "doc_id long, x array<double>")


def learned(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, features: DataFrame | None = None) -> Ranking:
    """Weights from at most ``rows`` labelled rows, those with the smallest hash of their id; all else from all of them.

    ``labels`` holds doc_id and quality; rows with another quality than 0 or 1, or
    without doc_id, are left out, and an id with several labels counts with the
    smallest. An id in several rows of ``docs`` gives several labelled rows.
    ``features`` is :func:`described` of ``docs``, where it is at hand.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    features = described(docs) if features is None else features
    labelled = features.where("doc_id is not null").join(known, "doc_id").withColumn(
        "s", F.shiftrightunsigned(F.xxhash64("doc_id"), 12))
    labelled = written(labelled, "labelled")
    at = [F.col("x")[k] for k in range(WIDTH)]
    found = labelled.agg(F.count("*"), F.count(F.when(F.col("quality") == 0, 1)), *map(F.avg, at),
                         *map(F.stddev_pop, at)).first()
    count, bad = found[:2]
    # the cut-off of the hash is found first, so no more rows than the sample has leave the executors
    chosen = labelled.where(F.col("s") <= int(value_at(labelled, rows - 1))) if count > rows else labelled
    sample = chosen.orderBy("s", "doc_id", "x").limit(rows).toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, WIDTH)
    moments = (np.array(found[2:2 + WIDTH]), np.array(found[2 + WIDTH:])) if count else None
    ranking = fit_ranking(x, sample["quality"].to_numpy(), moments)
    ranking.threshold = 0.0
    if 0 < bad < count and ranking.weights.any():
        values = written(labelled.select("x").mapInArrow(lambda it: _strengths(it, ranking), "s double"), "strengths")
        ranking.threshold = (value_at(values, bad - 1) + value_at(values, bad)) / 2
    return ranking


def scored(docs: DataFrame, ranking: Ranking, features: DataFrame | None = None) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: better) for every row of ``docs``.

    A null text counts as empty; a text without words has all features 0 and gets
    the score that the ranking gives those. A row without doc_id keeps its null;
    repeated rows each give a row. Other columns are not read. An empty table
    gives an empty result.
    """
    features = described(docs) if features is None else features
    return features.mapInArrow(lambda it: _scores(it, ranking), "doc_id long, score double")


def accepted(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least 0.5; they are filtered where they are read."""
    return in_small_batches(docs).mapInArrow(lambda it: _accept(it, ranking), docs.schema)


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.coalesce(id_crc(doc_id) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted``, learned from the labels that aren't held out."""
    features = written(described(docs), "described")  # every text is read once
    ranking = learned(docs, labels.where(~held_out(F.col("doc_id"))), features=features)
    return scored(docs, ranking, features).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
