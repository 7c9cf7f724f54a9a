"""Licence scans: exact phrases, and short notices found with bounded errors.

A notice may differ from its wording by a few edits. If a text holds it with at
most k edits, one of k + 1 parts of the wording stands there unchanged
(pigeonhole), so an automaton of these seeds finds all candidate places in one
pass; around each, the regex library matches the notice with at most k errors
and reports span and errors.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text

# The base phrases of the contract and their labels.
PHRASES = ((("mit", "license"), "mit"), (("apache", "license"), "apache"),
           (("general", "public", "license"), "gpl"))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Wordings of common short notices, lower-cased, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("spdx-license-identifier: mit", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the apache license, version 2.0", "apache"),
    ("spdx-license-identifier: apache-2.0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("spdx-license-identifier: gpl-", "gpl"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("licensed under the mozilla public license", "mpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by-nc 4.0", "cc-by-nc"),
    ("licensed under cc by-sa 4.0", "cc-by-sa"),
    ("licensed under cc by 4.0", "cc-by"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "proprietary"),
)
#: One edit is allowed for so many characters of a notice.
CHARS_PER_ERROR = 12


def parts(notice: str, count: int) -> list[tuple[int, str]]:
    """``count`` pieces of nearly equal length with their offsets."""
    cuts = [len(notice) * k // count for k in range(count + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class Hit:
    label: str
    notice: str
    start: int
    end: int
    errors: int

    @property
    def score(self) -> float:
        return 1 - self.errors / len(self.notice)


class Taken:
    """Disjoint spans, kept sorted."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, start)
        if at and self.ends[at - 1] > start or at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


class NoticeSearch:
    def __init__(self, notices=NOTICES, chars_per_error: int = CHARS_PER_ERROR):
        import ahocorasick
        import regex
        self.notices = [(text, label, len(text) // chars_per_error) for text, label in notices]
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(text, special_only=True)}){{e<={k}}}")
                         for text, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (text, _, k) in enumerate(self.notices):
            for offset, seed in parts(text, k + 1):
                seeds.setdefault(seed, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def search(self, text: str) -> list[Hit]:
        """Hits in a lower-cased text; of overlapping hits the one with the best score stays."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for number, offset in uses:
                notice, _, k = self.notices[number]
                begin = last - size + 1 - offset
                low, high = max(0, begin - k), min(len(text), begin + len(notice) + k)
                known = windows.setdefault(number, [])
                # seeds of one place arrive in order: overlapping windows are one
                if known and low <= known[-1][1]:
                    known[-1][0], known[-1][1] = min(known[-1][0], low), max(known[-1][1], high)
                else:
                    known.append([low, high])
        hits = []
        for number, places in windows.items():
            notice, label, k = self.notices[number]
            todo = [(low, high) for low, high in places]
            while todo:
                low, high = todo.pop()
                # the best match of a stretch, then those before and after it
                m = self.patterns[number].search(text, low, high) if high - low >= len(notice) - k else None
                if m:
                    hits.append(Hit(label, notice, m.start(), m.end(), sum(m.fuzzy_counts)))
                    todo += [(low, m.start()), (m.end(), high)]
        best: list[Hit] = []
        free = Taken()
        for hit in sorted(hits, key=lambda h: (-h.score, h.start - h.end, h.start, h.label)):
            if free.take(hit.start, hit.end):
                best.append(hit)
        return sorted(best, key=lambda h: (h.start, h.end, h.label))


_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def lowered(text: str) -> str:
    """A-Z in lower case and ASCII white space as spaces, code point by code point."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_SPACES).decode("utf-8", "surrogatepass")


def base_places(words: list[str]) -> list[tuple[int, str]]:
    out = []
    for phrase, label in PHRASES:
        for k in range(len(words) - len(phrase) + 1):
            if words[k] == phrase[0] and tuple(words[k:k + len(phrase)]) == phrase:
                out.append((k, label))
    return sorted(out)


_HIT = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("errors", T.LongType()),
                     T.StructField("score", T.DoubleType())])
_PLACE = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())])
_ARROW_HITS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                  ("errors", pa.int64()), ("score", pa.float64())]))
_ARROW_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    search = NoticeSearch()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            counts, places, hits = [], [], []
            for value in part.column("text"):
                text = lowered(value.as_py())
                words = WORD.findall(text)
                counts.append(len(words))
                places.append([{"word": k, "label": label} for k, label in base_places(words)]
                              if "license" in text else [])
                hits.append([{"label": h.label, "start": h.start, "end": h.end, "errors": h.errors, "score": h.score}
                             for h in search.search(text)])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, _ARROW_PLACES),
                 pa.array(hits, _ARROW_HITS)], names=["doc_id", "n_words", "places", "hits"])


def license_notices(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``places`` of exact phrases (word number, label) and fuzzy ``hits``
    (label, start, end in code points, errors, score) of every row of ``docs``.

    A null or empty text has no words, places or hits. A row without doc_id keeps
    its null; repeated rows each give a row. Other columns are not read. An empty
    table gives an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("places", T.ArrayType(_PLACE)), T.StructField("hits", T.ArrayType(_HIT))])
    return id_text(docs).mapInArrow(_scan, schema)


def license_digests(docs: DataFrame) -> DataFrame:
    """Counts and labels per document; ``score`` is 1 for an exact phrase, else the best hit's, else 0."""
    base = F.array_distinct(F.col("places.label"))
    every = F.array_distinct(F.concat(F.col("places.label"), F.col("hits.label")))
    return license_notices(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max("hits.score"), F.lit(0.0))).alias("score"))
