"""Edit distance of many pairs at once.

``levenshtein`` looks at every pair of characters. Here 64 characters of the longer text share a
machine word (Myers 1999, blocks as in Hyyro 2003) and numpy steps a batch of pairs together, so a
pair costs a few operations per character of the shorter text and word of the longer one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

LONGEST = 1024  # longer texts are few to a batch, so they stay with ``levenshtein``
TABLE = 1 << 19  # words of the table of character places, which bounds the pairs taken together

_ONE, _TOP = np.uint64(1), np.uint64(63)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, where each text starts, and the lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    return codes, np.cumsum(lengths) - lengths, lengths


def _padded(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One row a text, as wide as the longest; 0 beyond a text's end."""
    width = np.arange(int(lengths.max()))
    inside = width < lengths[:, None]
    return np.where(inside, codes[np.where(inside, starts[:, None] + width, 0)], 0)


def _block_distances(long: np.ndarray, m: np.ndarray, short: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Distances of pairs sorted by falling ``n``; ``m`` (at least 1) takes the same number of words in all of them."""
    pairs, words = len(m), -(-int(m.max()) // 64)
    places = np.zeros((words, pairs, size), np.uint64)
    rows = np.arange(pairs)
    for i in range(int(m.max())):
        has = rows[m > i]
        places[i // 64, has, long[has, i]] |= _ONE << np.uint64(i % 64)
    up, down = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    last = (m - 1).astype(np.uint64) % np.uint64(64)
    score = m.copy()
    for j in range(int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -j, side="left"))  # the pairs with more than j characters
        char = short[:k, j]
        up_in, down_in = np.full(k, _ONE), np.zeros(k, np.uint64)
        for w in range(words):
            pv, mv = up[w, :k], down[w, :k]
            eq = places[w, rows[:k], char]
            xv = eq | mv
            eq = eq | down_in
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if w == words - 1:
                score[:k] += ((ph >> last[:k]) & _ONE).astype(np.int64) - ((mh >> last[:k]) & _ONE).astype(np.int64)
            ph_in, mh_in = (ph << _ONE) | up_in, (mh << _ONE) | down_in
            up_in, down_in = ph >> _TOP, mh >> _TOP
            up[w, :k], down[w, :k] = mh_in | ~(xv | ph_in), ph_in & xv
    return score


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of the pairs ``(a[i], b[i])``, counted in code points."""
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    codes, starts, lengths = _codes([t for p in pairs for t in p])
    if not len(codes):
        return np.zeros(len(pairs), np.int64)
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    size = int(used.sum())
    codes = (np.cumsum(used) - 1)[codes]
    m, n = lengths[0::2], lengths[1::2]
    out = np.zeros(len(pairs), np.int64)  # two empty texts are equal
    words = -(-m // 64)
    for w in np.unique(words[words > 0]):
        of = np.flatnonzero(words == w)
        of = of[np.argsort(-n[of], kind="stable")]
        step = max(1, TABLE // (size * int(w)))
        for i in range(0, len(of), step):
            p = of[i:i + step]
            out[p] = _block_distances(_padded(codes, starts[2 * p], m[p]), m[p],
                                      _padded(codes, starts[2 * p + 1], n[p]), n[p], size)
    return out


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    both = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    out[both] = distances(a[both].tolist(), b[both].tolist())
    return out


def edit_distance(a: Column, b: Column) -> Column:
    """``levenshtein(a, b)``: texts of up to ``LONGEST`` characters in batches, others pair by pair."""
    short = (F.length(a) <= LONGEST) & (F.length(b) <= LONGEST) & F.is_valid_utf8(a) & F.is_valid_utf8(b)
    return F.when(short, _distance(F.when(short, a), F.when(short, b))).otherwise(F.levenshtein(a, b))
