"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. At each level runs of one symbol become one
symbol, deterministic coin tossing reduces the symbols to a few labels that
differ between neighbours, and the sequence is cut before every local minimum of
the labels. A phrase's name is a hash of its symbols, and the names are the next
level's sequence. Cuts depend on a handful of neighbours only, so equal
substrings get equal names except near their ends, wherever they stand. The
fingerprint keeps the smallest names of the upper levels in ``SLOTS`` slots.

The texts of a slice are parsed together as one array with document borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import id_text, written

SLOTS = 64
LEVELS = 24          # a phrase has two symbols at least, so more levels than any text needs
FROM_LEVEL = 2       # phrases of the first level are too short to tell texts apart
SLICE_CHARS = 120_000

_EMPTY = np.uint32(0xFFFFFFFF)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29, _ONE = np.uint64(32), np.uint64(29), np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _K3
    return x ^ (x >> _S29)


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: the lowest bit that differs from the left neighbour, and its value."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = ~label[first]  # a document's first symbol is compared with its complement
    bit = np.bitwise_count(((label ^ left) - _ONE) & ~(label ^ left)).astype(np.uint64)
    return (bit << _ONE) | ((label >> bit) & _ONE)


def _level(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and documents of the phrases of one level."""
    n = len(symbols)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[1:] |= doc[1:] != doc[:-1]
    start = np.flatnonzero(new)
    if len(start) < n:
        run = np.diff(np.append(start, n)).astype(np.uint64)
        symbols, doc = symbols[start], doc[start]
        symbols = np.where(run > _ONE, _mix(symbols + run * _K2), symbols)
        n = len(symbols)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(doc[1:], doc[:-1], out=first[1:])
    label = symbols
    for _ in range(3):  # 64 bits -> 128 labels -> 14 -> 8
        label = _toss(label, first)
    label = label.astype(np.int8)
    cut = first.copy()
    # a local minimum begins a phrase unless it would leave a document's first or last symbol alone
    cut[2:-1] |= ((label[2:-1] < label[1:-2]) & (label[2:-1] < label[3:])
                  & ~first[1:-2] & ~first[3:])
    start = np.flatnonzero(cut)
    place = np.arange(n, dtype=np.uint64) - np.repeat(start, np.diff(np.append(start, n))).astype(np.uint64)
    names = _mix(np.add.reduceat(_mix(symbols * _K1 + place * _K2 + _K1), start))
    return names, doc[start]


def sketches(texts: list[str]) -> np.ndarray:
    """One row of ``SLOTS`` unsigned 32-bit values per text; an empty slot is all ones."""
    out = np.full((len(texts), SLOTS), _EMPTY, np.uint32)
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
            size += len(texts[end])
            end += 1
        _sketch(texts[at:end], out[at:end])
        at = end
    return out


def _sketch(texts: list[str], out: np.ndarray) -> None:
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return
    flat = out.reshape(-1)
    symbols = _mix((points.astype(np.uint64) + _ONE) * _K1)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    for level in range(1, LEVELS + 1):
        symbols, doc = _level(symbols, doc)
        alone = np.ones(len(doc), bool)  # the only phrase left of its document: the parse's root
        same = doc[1:] == doc[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        take = alone if level < FROM_LEVEL else np.ones(len(doc), bool)
        name = symbols[take]
        slot = doc[take].astype(np.int64) * SLOTS + (name % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(flat, slot, (name >> _S32).astype(np.uint32))
        if alone.all():
            return
        symbols, doc = symbols[~alone], doc[~alone]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either text fills; 1 for two empty texts."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    equal = ((a == b) & filled).sum(axis=1)
    total = filled.sum(axis=1)
    return np.where(total == 0, 1.0, equal / np.maximum(total, 1))


def as_bytes(sketch: np.ndarray) -> list[bytes]:
    """All 32 bits of each slot, what :func:`likeness` compares; an empty slot is all ones."""
    return [row.astype(">u4").tobytes() for row in sketch]


def as_text(sketch: np.ndarray) -> list[str]:
    """:func:`as_bytes` in hexadecimal, as results hold it."""
    return [x.hex() for x in as_bytes(sketch)]


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as many leading code points of the following text, or all it has."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")
ROW = f"part int, border int, {RESULT}, text string"
NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]


def _describe(ids: list, texts: list[str], following: list[str], mine: np.ndarray, nexts: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following)]
    theirs = sketches(changed)
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
            pa.array(as_bytes(mine), pa.binary()), pa.array(as_bytes(theirs), pa.binary()), pa.array(likeness(mine, theirs), pa.float64()),
            pa.array(likeness(mine, nexts), pa.float64())]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition; its first and last texts go out too, for the partitions beside it."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()

    def border(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        row = dict.fromkeys(NAMES) | {"part": part, "border": kind, "doc_id": doc_id, "text": text}
        return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

    held: tuple | None = None  # the last row so far: id, text, sketch
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
            marks = sketches(texts)
            if held is None:
                yield border(0, ids[0], texts[0])
            else:
                ids, texts, marks = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], marks])
            n = len(ids) - 1
            if n:
                done = _describe(ids[:n], texts[:n], texts[1:], marks[:n], marks[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([None] * n, pa.int32()), *done,
                     pa.nulls(n, pa.string())], schema=_SCHEMA)
            held = (ids[n], texts[n], marks[n:])
    if held is not None:
        yield border(1, held[0], held[1])


def _at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            texts, following = row.column("text").to_pylist(), row.column("following").to_pylist()
            done = _describe(row.column("doc_id").to_pylist(), texts, following, sketches(texts), sketches(following))
            yield pa.RecordBatch.from_arrays(done, names=NAMES)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in ROW.split(", ")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text and compare both with it and with the next document.

    Returns one row per row of ``docs``: ``doc_id``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``
    and ``near_next`` (likeness, 0 to 1). The next document follows in ascending
    doc_id; after the last comes the first.

    A null text counts as empty; two empty texts have likeness 1, an empty and
    another text 0. Rows without doc_id stand first; rows with one doc_id stand
    in the order of their texts. A table of one row is its own next document.
    Other columns are not read. An empty table gives an empty result.
    """
    ordered = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = written(ordered.mapInArrow(_in_order, ROW), "fingerprints")
    inner = rows.where("border is null").select(*NAMES)
    # two border rows per partition
    heads = rows.where("border = 0").select("part", F.col("text").alias("following"))
    by_part = Window.orderBy("part")
    order = heads.select("part", F.coalesce(
        F.lead("part").over(by_part),
        F.first("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("next"))
    tails = (rows.where("border = 1").select("part", "doc_id", "text").join(order, "part")
             .join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following"))
    both = inner.unionByName(tails.mapInArrow(_at_borders, RESULT))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
