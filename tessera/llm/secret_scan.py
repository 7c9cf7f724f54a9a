"""Secret scans: base patterns, and spans of high entropy by a sliding window.

A candidate is a run of token characters. For each character class (hexadecimal
of either case, upper case with digits, base64), over the class's own longest runs
in the candidate, the Shannon entropy of a sliding window is kept by incremental
counts: moving the window by one character changes two counts and two terms of the
sum. Windows over the class's threshold merge into spans; a run shorter than the
window is judged by a threshold scaled to its length. Spans on the allow-list
(identifiers in known public forms, numbers, paths and names whose letters read as
words, and what is no longer suspect without its placeholders) are left out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, in_small_batches

# The base patterns of the contract and their least lengths.
ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")


@dataclass(frozen=True)
class CharacterClass:
    name: str
    letters: re.Pattern
    window: int
    bits: float  # a window of at least this entropy is suspect


#: Every class judges its own runs.
CLASSES = (
    CharacterClass("hex", re.compile(r"[0-9a-f]+"), 20, 3.0),
    CharacterClass("upper hex", re.compile(r"[0-9A-F]+"), 20, 3.0),
    CharacterClass("upper", re.compile(r"[A-Z0-9]+"), 16, 3.2),
    CharacterClass("base64", re.compile(r"[A-Za-z0-9+/_-]+={0,2}"), 24, 4.0),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST_RUN = 16
#: Candidates and spans that aren't secrets: a whole match suppresses them.
ALLOWED = tuple(re.compile(p) for p in (
    r"[0-9_=/+-]+",                                   # numbers, dates, rulers
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"[A-Z0-9]{13}EXAMPLE|[A-Za-z0-9+/]{30}EXAMPLEKEY",  # the published sample keys
))
#: Words, paths and names with a number, if :func:`wordlike` agrees.
JOINED = re.compile(r"[A-Za-z]+([_/=+-]+[A-Za-z]+)*[_/=+-]*[0-9]{0,4}")
_PART = re.compile(r"[A-Za-z]+")
_CASE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Pairs of letters that words hardly hold: after j, q, v, x, z and before j, q, x, and some more.
_ODD_PAIR = re.compile(r"(?=q[^u]|[jv][b-df-hj-np-tvwxz]|x[b-df-hj-np-rtvwxz]|z[b-df-hj-np-su-vx]"
                       r"|[b-df-hj-np-rtvwz][jqx]|[kw][bcdfgjmpqvxzkw]|[gpfmd][vwjqxz])")
#: Parts of a span that speak for no secret: placeholders and UUIDs.
HARMLESS = re.compile(r"EXAMPLE|example|x{4,}|X{4,}|0{7,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def entropy_windows(text: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows whose Shannon entropy is at least ``bits``.

    With counts c over a window of w characters the entropy is
    log2(w) - sum(c log2 c) / w; a text shorter than the window is one window.
    """
    w = min(window, len(text))
    if not w:
        return
    term = [0.0] + [c * math.log2(c) for c in range(1, w + 1)]
    most = (math.log2(w) - bits) * w + 1e-9
    counts: dict[str, int] = {}
    total = 0.0
    begin = end = -1
    for at, char in enumerate(text):
        if at >= w:  # the old character leaves first: no count passes w
            gone = text[at - w]
            c = counts[gone]
            total += term[c - 1] - term[c]
            counts[gone] = c - 1
        c = counts.get(char, 0)
        total += term[c + 1] - term[c]
        counts[char] = c + 1
        if at >= w - 1 and total <= most:
            start = at - w + 1
            if begin >= 0 and start > end:
                yield begin, end
                begin = start
            elif begin < 0:
                begin = start
            end = at + 1
    if begin >= 0:
        yield begin, end


def wordlike(name: str) -> bool:
    """Letters that read as words: few changes of case and few odd pairs for their number.

    Of random letters, 98 percent of mixed case are told apart at any length from
    16, and 85 (16 letters) to 98 percent (32) of one case.
    """
    parts = _PART.findall(name)
    letters = sum(map(len, parts))
    changes = sum(len(_CASE.findall(p)) - 1 for p in parts)
    odd = sum(len(_ODD_PAIR.findall(p.lower())) for p in parts)
    return changes <= letters / 3 and odd < max(2, 0.08 * letters)


def _allowed(candidate: str) -> bool:
    return any(p.fullmatch(candidate) for p in ALLOWED) or bool(JOINED.fullmatch(candidate)) and wordlike(candidate)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(word in lower for word in ASSIGN_WORDS):
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _suspect(run: str, kind: CharacterClass) -> Iterator[tuple[int, int]]:
    """Spans of a run by the class's window; under its length, the threshold is the same share of the most possible."""
    if len(run) < LEAST_RUN:
        return iter(())
    bits = kind.bits * min(1.0, math.log2(len(run)) / math.log2(kind.window))
    return entropy_windows(run, kind.window, bits)


def _harmless(span: str, kind: CharacterClass) -> bool:
    """A span on the allow-list, or one that isn't suspect without its placeholders."""
    if _allowed(span.strip("_/=+-")):
        return True
    rest = HARMLESS.sub("", span)
    return rest != span and not any(_suspect(rest, kind))


def _judged(run: str, kind: CharacterClass) -> Iterator[tuple[int, int]]:
    """The suspect spans of a run that aren't harmless with the placeholders that they cut taken whole."""
    marks = [m.span() for m in HARMLESS.finditer(run)]
    for a, b in _suspect(run, kind):
        first = bisect_right(marks, a, key=lambda x: x[1])
        last = bisect_left(marks, b, key=lambda x: x[0]) - 1
        low = min(a, marks[first][0]) if first < len(marks) else a
        high = max(b, marks[last][1]) if last >= 0 else b
        if not _harmless(run[low:high], kind):
            yield a, b


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of all classes; those that overlap are one."""
    out: list[tuple[str, int, int]] = []
    for m in CANDIDATE.finditer(text):
        candidate = m[0]
        if _allowed(candidate):
            continue
        found = sorted((run.start() + a, run.start() + b) for kind in CLASSES for run in kind.letters.finditer(candidate)
                       for a, b in _judged(run[0], kind))
        end = -1
        for a, b in found:
            if a < end:
                _, start, _ = out.pop()
                a, b = start - m.start(), max(b, end)
            out.append(("entropy", m.start() + a, m.start() + b))
            end = b
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; offsets in code points, end exclusive."""
    return in_order(base_spans(text) + entropy_spans(text))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span replaced by ``[SECRET]``, overlapping ones by one."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch], redact: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column("text").to_pylist()
            found = [scan(t) for t in texts]
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], _ARROW_SPANS)
            clean = pa.array([redacted(t, s) if redact and s else None for t, s in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), spans, clean],
                                             names=["doc_id", "spans", "redacted"])


def secret_spans(docs: DataFrame, redact: bool = False) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end) for every row of ``docs``.

    With ``redact``, ``redacted`` holds the text with its spans replaced where it
    has any, else null. A null or empty text has no spans. A row without doc_id
    keeps its null; repeated rows each give a row. Other columns are not read.
    An empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS),
                           T.StructField("redacted", T.StringType())])
    out = id_text(docs).mapInArrow(lambda it: _scan(it, redact), schema)
    return out if redact else out.drop("redacted")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [t if t is None else redacted(t, scan(t)) for t in part.column("text").to_pylist()]
            new = {"text": texts, "n_chars": [t if t is None else len(t) for t in texts]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], f.type) if f.name in new else part.column(k) for k, f in enumerate(part.schema)],
                schema=part.schema)


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced and ``n_chars``, where there is one, counted anew."""
    return in_small_batches(docs).mapInArrow(_clean, docs.schema)


def joined(spans, kinds=None):
    """kind:start:end, comma-joined, as a column; only the given kinds."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_digests(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    return secret_spans(docs).select(
        "doc_id", *(count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(spans, BASE_KINDS), 256).alias("base_sha256"), joined(spans).alias("spans"))
