"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding merges adjacent symbols from an agenda ordered by piece score, then by
position. Two neighbouring symbols can only ever merge into pieces that hold
their touching characters side by side, so a text is cut wherever no piece has
that pair of characters; each distinct cut is encoded once and kept. Every cut
that a task meets for the first time and that begins with a space is also encoded
by the sentencepiece library, in one call per Arrow batch, and so is every text
with runs of spaces; any difference raises an error. Ids are decoded by the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, joined_ids, slices, words_of

SPACE = "▁"
CACHE_BYTES = 96 << 20  # what the known words of a worker take, about; the same again for cuts of words
ENTRY_BYTES = 220       # a word and its ids, besides their own bytes
LONGEST = 64            # characters of a word that is kept
CHARS_AT_ONCE = 1_000_000
CHECKED_TEXTS = 8  # whole texts of each Arrow batch that the library encodes as well

NORMAL, BYTE = 1, 6  # piece types of the model format


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes exactly as the library does, for models that keep texts as they are; ``library`` decodes."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        spec = proto.ModelProto()
        with open(model, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if (spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or not norm.escape_whitespaces):
            raise ValueError("a merge-type model with identity normalisation is needed")
        self.rank: dict[str, float] = {}  # piece -> minus its score
        self.id: dict[str, int] = {}
        self.byte_id = [self.library.unk_id()] * 256
        for i, p in enumerate(spec.pieces):
            if p.type == BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
            elif p.type == NORMAL:
                self.rank[p.piece] = -p.score
                self.id[p.piece] = i
        self.pairs = {p[k:k + 2] for p in self.rank for k in range(len(p) - 1)}
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.pairs):
            raise ValueError("pieces must not run across a space")
        self._words: dict[str, bytes] = {}
        self._cuts: dict[str, bytes] = {}
        self._held = {"words": 0, "cuts": 0}  # bytes

    def merge(self, symbols: str) -> list[int]:
        """Ids of one cut: pop the best adjacent pair, merge it and put its new neighbours on the agenda."""
        n, rank = len(symbols), self.rank
        part = list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # (rank of the merged piece, its left place, the piece): the best score first, then the leftmost
        agenda = [(rank[m], k, m) for k in range(n - 1) if (m := symbols[k:k + 2]) in rank]
        heapify(agenda)
        while agenda:
            _, left, merged = heappop(agenda)
            right = after[left]
            # an entry is stale once either side has changed
            if right >= n or part[left] + part[right] != merged:
                continue
            part[left], part[right] = merged, ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                m = merged + part[follow]
                if m in rank:
                    heappush(agenda, (rank[m], left, m))
            lead = before[left]
            if lead >= 0:
                m = part[lead] + merged
                if m in rank:
                    heappush(agenda, (rank[m], lead, m))
        out: list[int] = []
        for piece in part:
            if piece:
                known = self.id.get(piece)
                out.extend([known] if known is not None else [self.byte_id[b] for b in piece.encode()])
        return out

    def _word(self, word: str) -> bytes:
        """Ids of a run of spaces with what follows up to the next space."""
        pairs, start, found = self.pairs, 0, []
        ends = [k + 1 for k in range(len(word) - 1) if word[k:k + 2] not in pairs]
        for end in [*ends, len(word)]:
            cut = word[start:end]
            ids = self._cuts.get(cut)
            if ids is None:
                ids = array("i", self.merge(cut)).tobytes()
                if len(cut) <= LONGEST // 2:
                    self._cuts[cut] = ids
                    self._held["cuts"] += ENTRY_BYTES + 2 * len(cut) + len(ids)
            found.append(ids)
            start = end
        return b"".join(found) if len(found) > 1 else found[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The 32-bit ids of all texts and where each text's begin."""
        if self._held["cuts"] > CACHE_BYTES:
            self._cuts, self._held["cuts"] = {}, 0
        if self._held["words"] > CACHE_BYTES:
            self._words, self._held["words"] = {}, 0
        offsets, place, distinct = words_of([t.replace(SPACE, " ") for t in texts])
        ids = list(map(self._words.get, distinct))
        new = [k for k, known in enumerate(ids) if known is None and distinct[k]]
        for k in new:
            word = distinct[k]
            ids[k] = self._word(SPACE + word)
            if len(word) <= LONGEST:
                self._words[word] = ids[k]
                self._held["words"] += ENTRY_BYTES + 2 * len(word) + len(ids[k])
        self._check([distinct[k] for k in new], [ids[k] for k in new])
        empty = distinct.index("") if "" in distinct else -1
        if empty >= 0:
            ids[empty] = b""
        tokens, ends = joined_ids(ids, place, offsets)
        odd = np.logical_or.reduceat(place == empty, offsets[:-1]) if len(texts) and empty >= 0 else np.zeros(len(texts), bool)
        if not odd.any():
            return tokens, ends
        # "" is a space more than one between words, or at an end: such texts are cut at runs of spaces
        parts = []
        for k, text in enumerate(texts):
            if odd[k]:
                runs = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)) if text else []
                parts.append(np.frombuffer(b"".join(map(self._word, runs)), "<i4"))
                self._check([text], [parts[-1].tobytes()])
            else:
                parts.append(tokens[ends[k]:ends[k + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])

    def _check(self, texts: list[str], ids: list[bytes]) -> None:
        for text, mine, theirs in zip(texts, ids, self.library.encode(texts, num_threads=1)):
            if array("i", theirs).tobytes() != mine:
                raise AssertionError(f"the library encodes {text[:100]!r} otherwise")


@lru_cache(maxsize=1)
def codec(model: str) -> Codec:
    """One codec per Python worker: its caches serve all the tasks that the worker runs."""
    return Codec(model)


def _encoded(batches: Iterator[pa.RecordBatch], pieces: Codec) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of the batches: doc ids, the ids of all texts and where each text's begin."""
    for batch in batches:
        at = 0
        for texts in slices((t.as_py() for t in batch.column("text")), CHARS_AT_ONCE):
            ids, ends = pieces.encode(texts)
            if not at:
                seen = pieces.library.encode(texts[:CHECKED_TEXTS], num_threads=1)
                if any(ids[ends[k]:ends[k + 1]].tolist() != x for k, x in enumerate(seen)):
                    raise AssertionError("the library encodes a text otherwise")
            yield batch.column("doc_id").slice(at, len(texts)), ids, ends
            at += len(texts)


def _decoded(pieces: Codec, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    decode = pieces.library.decode
    return pa.array([decode(ids[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(ids.astype(np.int32)))


def _encode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    for doc_id, ids, ends in _encoded(batches, codec(model)):
        yield pa.RecordBatch.from_arrays([doc_id, _lists(ids, ends)], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    pieces = codec(model)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lists = part.column("ids").fill_null([])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = _decoded(pieces, lists.flatten().to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), texts], names=["doc_id", "ids", "text"])


def _round_trip(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    pieces = codec(model)
    for doc_id, ids, ends in _encoded(batches, pieces):
        yield pa.RecordBatch.from_arrays([doc_id, _lists(ids, ends), _decoded(pieces, ids, ends)],
                                         names=["doc_id", "ids", "text"])


def piece_ids(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of ints, no begin or end ids) of every row of ``docs``.

    A null or empty text has no ids. A row without doc_id keeps its null.
    Repeated rows each give a row. Other columns are not read. An empty table
    gives an empty result.
    """
    model = model or default_model()
    return id_text(docs).mapInArrow(lambda it: _encode(it, model), "doc_id long, ids array<int>")


def piece_texts(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and the decoded ``text``; null or empty ids decode to an empty text."""
    model = model or default_model()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, model),
                                                      "doc_id long, ids array<int>, text string")


def piece_round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``piece_texts(piece_ids(docs))`` in one pass through Python: ``doc_id``, ``ids`` and the text decoded from them."""
    model = model or default_model()
    return id_text(docs).mapInArrow(lambda it: _round_trip(it, model), "doc_id long, ids array<int>, text string")


def piece_digests(docs: DataFrame) -> DataFrame:
    return piece_round_trip(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
