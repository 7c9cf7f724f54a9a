"""Byte-level BPE ids by the tokenizers library, with a cache of chunks inside each task.

The vocabulary splits a text before every single space that stands between two
characters that aren't white space, so such chunks are encoded apart and common
ones only once. A text with any other arrangement of spaces is encoded whole, and
so is one that holds an added token (``<|endoftext|>``) where those are read as such.
What a worker keeps is bounded in bytes, and long chunks aren't kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gathered, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

CACHE_BYTES = 128 << 20  # what the known chunks of a worker take, about
ENTRY_BYTES = 170        # a chunk's name and places, besides its characters and ids
LONGEST = 64             # characters of a chunk that is kept
CHARS_AT_ONCE = 2_000_000
UNEVEN = -1              # in place of the number of ids: white space begins or ends the chunk
END = np.zeros(1, np.uint32).tobytes()


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Chunks:
    """Chunks and their ids, all in one array; a chunk's number says where its ids begin and how many there are."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, "<u4")
        self.bytes = 0

    def add(self, chunks: list[str], size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Numbers of new chunks; those longer than ``LONGEST`` get one that isn't looked up again."""
        first, held = len(self.size), np.maximum(size, 0)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(held) - held])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        numbers = np.arange(first, len(self.size))
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        if lengths.max() <= LONGEST:
            self.number.update(zip(chunks, numbers.tolist()))
        else:
            self.number.update((c, k) for k, c in enumerate(chunks, first) if len(c) <= LONGEST)
        self.bytes += ENTRY_BYTES * len(chunks) + 2 * int(lengths.sum()) + flat.nbytes
        return numbers

    def find(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, chunks, repeat(-1)), np.int64, len(chunks))

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of some chunks."""
        size, every = self.size[numbers], np.arange(len(numbers))
        return size, gathered(self.flat, self.start[numbers], np.maximum(size, 0), every, np.empty(0, np.int64))[0]


class Encoder:
    """``encode(texts)`` gives each text's ids as bytes of little-endian 32-bit integers.

    With ``added``, added tokens in a text get their own ids, as the library does
    by default; without, special ones are encoded like any other characters.
    """

    def __init__(self, vocabulary: str, added: bool = False):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._tokenizer.encode_special_tokens = not added
        self._added = tuple(t.content for t in self._tokenizer.get_added_tokens_decoder().values()) if added else ()
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        # the vocabulary writes every byte as one character
        self._widths = np.array([len(self._tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        # two generations: a chunk met again moves from the old one to the new one
        self._chunks, self._old = Chunks(), Chunks()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of chunks that white space neither begins nor ends, encoded in one call and cut where their
        bytes end; the others are ``UNEVEN``."""
        even = [c for c in chunks if c and c == c.strip()]
        if len(even) == len(chunks):
            every = slice(None)
        else:
            every = np.fromiter((bool(c) and c == c.strip() for c in chunks), bool, len(chunks))
        size = np.full(len(chunks), UNEVEN, np.int32)
        if not even:
            return size, np.empty(0, "<u4")
        ids = self._ids(" " + " ".join(even))
        ends = np.cumsum(pc.binary_length(pa.array(even, pa.large_string())).to_numpy() + 1)
        cuts = np.searchsorted(np.cumsum(self._widths[ids]), ends) + 1
        size[every] = np.diff(cuts, prepend=0)
        return size, ids

    def _known(self, chunks: list[str]) -> tuple[Chunks, np.ndarray]:
        """The numbers of chunks, which may repeat, and where they are held."""
        if self._chunks.bytes > CACHE_BYTES // 2:
            self._old, self._chunks = self._chunks, Chunks()
        held = self._chunks
        numbers = held.find(chunks)
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            missing = [chunks[k] for k in new]
            names = list(dict.fromkeys(missing))
            before = self._old.find(names)
            found = np.empty(len(names), np.int64)
            again, fresh = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            if len(again):
                found[again] = held.add([names[k] for k in again.tolist()], *self._old.of(before[again]))
            if len(fresh):
                some = [names[k] for k in fresh.tolist()]
                found[fresh] = held.add(some, *self._learned(some))
            here = dict(zip(names, found.tolist()))  # long chunks, too
            numbers[new] = np.fromiter(map(here.__getitem__, missing), np.int64, len(missing))
        return held, numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        added = [any(t in text for t in self._added) for text in texts]
        if any(added):
            rest = iter(self.encode([text for text, h in zip(texts, added) if not h]))
            return [self._ids(text).tobytes() if h else next(rest) for text, h in zip(texts, added)]
        if not texts:
            return []
        chunks, counts = [], []
        for text in texts:
            own = text.split(" ")
            chunks += own
            counts.append(len(own))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        held, numbers = self._known(chunks)
        size = held.size[numbers]
        whole = np.logical_or.reduceat(size < 0, offsets[:-1])
        size = np.maximum(size, 0)
        tokens, ends = gathered(held.flat, held.start[numbers], size, slice(None), offsets)
        out = []
        for k, text in enumerate(texts):
            if whole[k]:
                out.append(self._ids(text).tobytes() if text else b"")
                continue
            # the first chunk has no space before it
            first = int(offsets[k])
            out.append(self._ids(chunks[first]).tobytes() + tokens[ends[k] + size[first]:ends[k + 1]].tobytes())
        return out


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker: its cache serves all the tasks that the worker runs."""
    return Encoder(vocabulary, added=True)


def encoded(texts: Iterator[str], encoder: Encoder, chars_at_once: int = CHARS_AT_ONCE) -> Iterator[bytes]:
    """Ids of every text in turn, each with the end id 0, encoded in slices of bounded size."""
    for held in slices(texts, chars_at_once):
        yield from (ids + END for ids in encoder.encode(held))
