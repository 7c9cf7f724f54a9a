"""Packing documents into windows of fixed length, online, by the sum of squares.

Every task packs the documents of its own input split, so no text is moved. A
document longer than a window is cut into whole windows and a rest. A rest goes
where it leaves the smallest sum of squared counts of partially filled windows:
``count[h]`` is the number of open windows filled to level ``h`` and the level
array is all that a placement looks at. When a task's documents end, its open
windows are merged by cutting pieces, so that one at most stays unfilled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text
from .token_ids import default_vocabulary, encoded, encoder

WINDOW = 1024
#: Sequence numbers of a task start at its partition number times this.
TASK_SPAN = 1 << 32


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: bytes | memoryview
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:4 * at], self.doc_tokens),
                Piece(self.doc, self.start + at, self.ids[4 * at:], self.doc_tokens))


@dataclass
class SumOfSquares:
    """Open windows by fill level; ``place`` returns a window when it becomes full."""

    window: int = WINDOW
    count: np.ndarray = field(init=False)
    open: list[list[list[Piece]]] = field(init=False)

    def __post_init__(self):
        self.count = np.zeros(self.window + 1, np.int64)
        self.open = [[] for _ in range(self.window + 1)]

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, whose growth by ``size`` adds least to the sum of squares.

        Moving a window from level h to h+size adds 2(count[h+size] - count[h]) + 2,
        opening one adds 2 count[size] + 1 and filling one takes 2 count[h] - 1 off.
        Ties go to the fullest level.
        """
        top = self.window - size
        change = 2 * (self.count[size:] - self.count[:top + 1]) + 2
        change[0] = 2 * self.count[size] + 1
        change[top] = 1 - 2 * self.count[top] if top else 0
        change[1:][self.count[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        size = len(piece)
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        return None

    def drain(self) -> Iterator[list[Piece]]:
        """Close all open windows: the emptiest ones' pieces are cut to fill the fullest."""
        left = [pieces for windows in self.open for pieces in windows]
        spare: list[Piece] = []
        low = 0
        for high in range(len(left) - 1, -1, -1):
            if high < low:
                break
            pieces, fill = left[high], sum(map(len, left[high]))
            while fill < self.window:
                if not spare:
                    if low >= high:
                        break
                    spare, low = left[low], low + 1
                piece = spare.pop()
                if len(piece) > self.window - fill:
                    piece, rest = piece.cut(self.window - fill)
                    spare.append(rest)
                pieces.append(piece)
                fill += len(piece)
            yield pieces
        if spare:
            yield spare


def pack(documents: Iterator[tuple[int | None, bytes]], window: int = WINDOW) -> Iterator[list[Piece]]:
    """Windows of pieces from (doc_id, id bytes); every id lies in one piece."""
    levels = SumOfSquares(window)
    for doc, ids in documents:
        view, tokens = memoryview(ids), len(ids) // 4  # cut without copies; only the rest is kept longer
        full = tokens - tokens % window
        for start in range(0, full, window):
            yield [Piece(doc, start, view[4 * start:4 * (start + window)], tokens)]
        if full < tokens:
            done = levels.place(Piece(doc, full, bytes(view[4 * full:]), tokens))
            if done:
                yield done
    yield from levels.drain()


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, window: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    names: list[int | None] = []

    def texts() -> Iterator[str]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                names.append(doc_id)
                yield text.as_py()

    def documents() -> Iterator[tuple[int | None, bytes]]:
        for at, ids in enumerate(encoded(texts(), encoder(vocabulary))):
            yield names[at], ids
            names[at] = None

    sequence = TaskContext.get().partitionId() * TASK_SPAN
    rows: list[tuple] = []
    for pieces in pack(documents(), window):
        offset = 0
        for p in pieces:
            rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, offset,
                         bytes(p.ids) if with_ids else None))
            offset += len(p)
        sequence += 1
        if len(rows) >= 4096:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, ids = zip(*rows)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(ids, pa.binary())], names)


def packed_sequences(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW,
                     with_ids: bool = True) -> DataFrame:
    """Pack all documents into windows of at most ``window`` ids.

    Returns one row per piece: ``doc_id``, ``start`` (its document's ids before
    it), ``length``, ``ids_crc32``, ``doc_tokens`` (the document's ids, end id
    included), ``sequence_id``, ``offset`` (its place in the sequence, gapless
    from 0) and ``ids`` (little-endian unsigned 32-bit, null unless ``with_ids``).

    A null or empty text gives the end id alone. A row without doc_id is packed
    with a null doc_id. Repeated rows are packed each. Other columns are not
    read. An empty table gives an empty result. The result follows the input's
    splits: a repeated task packs the same rows in the same way.
    """
    vocabulary = vocabulary or default_vocabulary()
    return id_text(docs).mapInArrow(lambda it: _packed(it, vocabulary, window, with_ids), SCHEMA)
