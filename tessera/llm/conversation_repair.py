"""Repair of conversation structure by a run-length dynamic program.

A row is a symbol: the initial of its role and its fault. Editing rows so that the
roles read ``(s?(ua)+)?`` is a shortest path over four states (nothing yet, after
system, after user, after assistant); a symbol's step is a 4 x 4 min-plus matrix
whose entries hold a cost and the least string of edits. Equal consecutive symbols
are one run, and a run of r rows advances the states through the cached binary
powers of its symbol's matrix. Strings are ropes of shared halves with hashes, so a
power's strings of 2^k edits take a constant number of new nodes, and they are
written out only for the audit that is chosen.

Why least strings compose: two strings from one state to another over the same
rows, at the same cost, are never proper prefixes of each other, since what is
left would be insertions only and cost more. So the order stays the same whatever
follows. Between two states, a string that is a prefix of another differs from it
by trailing insertions; the states keep that difference (:data:`Relation`).

Spark collapses repeated rows, finds first occurrences and sorts; a task reads
narrow rows of a conversation in order and holds its runs, and a second pass
applies the audit to the texts as they come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, written

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)            # the state after an insertion or a change of role
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5        # costs; CUT is added where a truncated row stays
GONE, OK, TRUNCATED = "gone", "ok", "truncated"
DIFFERS = 1 << 40

#: How the strings of two states compare: -DIFFERS or DIFFERS by their first difference, else the second's
#: length less the first's, the longer one being the shorter one with insertions.
Relation = int

_MOD, _BASE = (1 << 61) - 1, 911_382_323


class Rope:
    """A string of edits as a tree of shared parts, with its length and a polynomial hash."""

    __slots__ = ("size", "hash", "left", "right", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.size, self.hash = len(text), 0
            for c in text:
                self.hash = (self.hash * _BASE + ord(c)) % _MOD
        else:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(_BASE, right.size, _MOD) + right.hash) % _MOD

    def __add__(self, other: Rope) -> Rope:
        return Rope(left=self, right=other) if self.size and other.size else self if self.size else other

    def head(self, n: int) -> int:
        """The hash of the first n characters."""
        out, at = 0, self
        while n:
            if at.left is None:
                for c in at.text[:n]:
                    out = (out * _BASE + ord(c)) % _MOD
                return out
            part = at.left
            if n >= part.size:
                out = (out * pow(_BASE, part.size, _MOD) + part.hash) % _MOD
                n -= part.size
                part = at.right
            at = part
        return out

    def char(self, n: int) -> str:
        at = self
        while at.left is not None:
            if n < at.left.size:
                at = at.left
            else:
                n -= at.left.size
                at = at.right
        return at.text[n]

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                yield at.text
            else:
                todo += [at.right, at.left]


def compare(a: Rope, b: Rope) -> Relation:
    low, high = 0, min(a.size, b.size)
    if a.head(high) == b.head(high):
        return b.size - a.size
    while high - low > 1:  # the first low characters agree, the first high don't
        mid = (low + high) // 2
        if a.head(mid) == b.head(mid):
            low = mid
        else:
            high = mid
    return -DIFFERS if a.char(low) < b.char(low) else DIFFERS


def smaller(relation: Relation) -> bool:
    """The first string comes first: it differs so, or it is a proper prefix."""
    return relation == -DIFFERS or 0 < relation < DIFFERS


Entry = tuple[int, Rope] | None
Symbol = tuple[str, str]  # initial of the role, or x, and what is wrong


def _step(symbol: Symbol) -> list[list[Entry]]:
    """One row's matrix: insertions before it, then its edit."""
    initial, fault = symbol
    kept = CUT if fault == TRUNCATED else 0
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        at = start
        for inserted in range(4):
            before = inserted * INSERT
            edits = [(DELETE, "D", at)]
            if fault != GONE:
                edits.append((REROLE + kept, "R", NEXT[at]))
                if initial == "s" and at == START:
                    edits.append((kept, "K", SYSTEM))
                elif initial == ("a" if NEXT[at] == ASSISTANT else "u"):
                    edits.append((kept, "K", NEXT[at]))
            for cost, letter, to in edits:
                way = (before + cost, "I" * inserted + letter)
                if best[start][to] is None or way < best[start][to]:
                    best[start][to] = way
            at = NEXT[at]
    return [[way and (way[0], Rope(way[1])) for way in row] for row in best]


@lru_cache(maxsize=1024)
def power(symbol: Symbol, level: int) -> list[list[Entry]]:
    """The matrix of 2**level equal rows."""
    if not level:
        return _step(symbol)
    half = power(symbol, level - 1)
    out: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for a in range(4):
        for b in range(4):
            for mid in range(4):
                if half[a][mid] and half[mid][b]:
                    way = (half[a][mid][0] + half[mid][b][0], half[a][mid][1] + half[mid][b][1])
                    now = out[a][b]
                    if now is None or way[0] < now[0] or way[0] == now[0] and smaller(compare(way[1], now[1])):
                        out[a][b] = way
    return out


States = tuple[tuple[int | None, ...], tuple[Relation, ...]]  # costs over the least one, and relations of all pairs
BEGIN: States = ((0, None, None, None), (0,) * 16)


def _related(relations: tuple[Relation, ...], a: int, x: Rope, b: int, y: Rope) -> Relation:
    """How state a's string with x after it compares to state b's with y."""
    known = relations[4 * a + b]
    if abs(known) == DIFFERS:
        return known
    more = Rope("I" * abs(known))
    return compare(x, more + y) if known >= 0 else compare(more + x, y)


@lru_cache(maxsize=65536)
def advance(symbol: Symbol, level: int, states: States) -> tuple[States, tuple[int | None, ...], int]:
    """The states after 2**level equal rows, the state each came from, and by how much the least cost grew.

    Costs over the least one are small and relations few, so nearly every call is answered from the cache.
    """
    costs, relations = states
    matrix = power(symbol, level)
    new: list[int | None] = [None] * 4
    came: list[int | None] = [None] * 4
    for to in range(4):
        for a in range(4):
            if costs[a] is None or matrix[a][to] is None:
                continue
            cost = costs[a] + matrix[a][to][0]
            if new[to] is None or cost < new[to] or cost == new[to] and smaller(
                    _related(relations, a, matrix[a][to][1], came[to], matrix[came[to]][to][1])):
                new[to], came[to] = cost, a
    pairs = [0] * 16
    for x in range(4):
        for y in range(x):
            if new[x] is not None and new[y] is not None:
                one = _related(relations, came[x], matrix[came[x]][x][1], came[y], matrix[came[y]][y][1])
                pairs[4 * x + y], pairs[4 * y + x] = one, -one
    least = min(c for c in new if c is not None)
    return (tuple(c if c is None else c - least for c in new), tuple(pairs)), tuple(came), least


def cheapest_edits(runs: list[tuple[Symbol, int]]) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of rows given as runs; the ASCII-least audit of those that tie."""
    states, total = BEGIN, 0
    steps: list[tuple[Symbol, int, tuple[int | None, ...]]] = []
    for symbol, length in runs:
        for level in range(length.bit_length()):
            if length >> level & 1:
                states, came, more = advance(symbol, level, states)
                total += more
                steps.append((symbol, level, came))
    costs, relations = states
    best = None
    for state, tail in ((START, ""), (ASSISTANT, ""), (USER, "I"), (SYSTEM, "II")):
        if costs[state] is None:
            continue
        cost = costs[state] + INSERT * len(tail)
        if best is None or cost < best[0] or cost == best[0] and smaller(
                _related(relations, state, Rope(tail), best[1], Rope(best[2]))):
            best = (cost, state, tail)
    cost, state, tail = best
    parts = [tail]
    for symbol, level, came in reversed(steps):
        parts.append("".join(power(symbol, level)[came[state]][state][1].leaves()))
        state = came[state]
    return total + cost, "".join(reversed(parts))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` (0: dropped, 2: repeated) of every row, null role and
    text as one space, damaged by the CRC of ``conv_id:turn`` (null there: one space, too)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def _content() -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _symbols(rows: DataFrame) -> DataFrame:
    """One narrow row per conversation, turn and content: ``initial``, ``fault``, ``copies`` and ``first``."""
    ending = F.rtrim("text", F.lit(SPACES))
    fault = (F.when(ending == "", "blank").when(~F.right(ending, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK))
    alike = rows.select("conv_id", "turn", "role", _content().alias("content"), fault.alias("fault"), "copies")
    alike = written(alike.groupBy("conv_id", "turn", "role", "content", "fault").agg(F.sum("copies").alias("copies")),
                    "repair-rows")
    # the place of a content's first row; nulls come before all turns
    seen = alike.where("copies > 0").groupBy(F.col("conv_id").alias("of"), F.col("content").alias("seen")).agg(
        F.min("turn").alias("first_turn"), F.max(F.col("turn").isNull()).alias("null_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("seen"))
    first = F.when(F.col("null_turn"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("first_turn"))
    return alike.join(seen, same, "left").select(
        "conv_id", "turn", "role", "content", "fault", "copies", F.substring("role", 1, 1).alias("initial"),
        F.coalesce(first, F.lit(False)).alias("first"))


_IN_ORDER = ["conv_id", "turn", "role", "content"]  # ascending: null first
_LEGAL = ("su", "ua", "au")
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """What is known of a conversation after some of its rows, in order."""

    def __init__(self):
        self.count = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.turns = 0
        self.last: str | None = None
        self.runs: list[tuple[Symbol, int]] = []

    def _extend(self, symbol: Symbol, length: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            length += self.runs.pop()[1]
        self.runs.append((symbol, length))

    def add(self, turn: int | None, initial: str, fault: str, copies: int, first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += 1
        if self.last is not None and self.last + initial not in _LEGAL:
            self.count["illegal"] += 1
        self.count["illegal"] += copies - 1  # a role never follows itself
        self.last = initial
        fresh = int(first and fault != "blank")
        if fresh:
            self._extend((initial if initial in "sua" and initial else "x", fault), 1)
            self.count["truncated"] += fault == TRUNCATED
        if copies > fresh:
            self._extend(("x", GONE), copies - fresh)
            self.count["blank" if fault == "blank" else "duplicate"] += copies - fresh

    def result(self) -> dict:
        if self.turns:
            self.count["gaps"] = self.high - self.low + 1 - self.turns
        self.count["cost"], audit = cheapest_edits(self.runs)
        return {**self.count, "audit": audit}


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in
                             ("conv_id", "turn", "initial", "fault", "copies", "first")))

    out: list[dict] = []
    for conv_id, own in groupby(rows(), key=lambda r: r[0]):
        conversation = _Conversation()
        for _, *row in own:
            conversation.add(*row)
        out.append({"conv_id": conv_id, **conversation.result()})
        if len(out) == 1000:
            yield _as_batch(out)
            out = []
    if out:
        yield _as_batch(out)


_AUDIT_SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {c: pa.int64() for c in ("conv_id", *_COUNTS)} | {"audit": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of every conversation of ``rows`` (as :func:`damaged` has them); written once."""
    narrow = _symbols(rows).repartition("conv_id").sortWithinPartitions(*_IN_ORDER)
    return written(narrow.mapInArrow(_audits, _AUDIT_SCHEMA), "repair-audits")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str | None, str]]:
    """Conversation, edit, role and text of every line of every repaired conversation; a conversation begins with an
    edit of "", and holds its audit and one batch of texts."""
    names = ("conv_id", "audit", "role", "text", "copies")
    conv_id, audit, at, state = None, "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at:at + 1] == "I":
            at, state = at + 1, NEXT[state]
            yield conv_id, "I", "user" if state == USER else "assistant", ""

    for batch in batches:
        for one, edits, role, text, copies in zip(*(batch.column(c).to_pylist() for c in names)):
            if edits is not None:
                yield from inserted()  # after the last row of the conversation before
                conv_id, audit, at, state = one, edits, 0, START
                yield conv_id, "", None, ""
                continue
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = SYSTEM if edit == "K" and state == START and role[0] == "s" else NEXT[state]
                yield conv_id, edit, role if edit == "K" else "user" if state == USER else "assistant", text
    yield from inserted()


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held, place = [], 0, 0
    names = ["conv_id", "place", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for conv_id, edit, role, text in _repaired(batches):
        place = place + 1 if edit else 0
        if edit:
            rows.append((conv_id, place, edit, role, text))
            held += len(text)
        if len(rows) == 1000 or held > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, hashes = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())],
                                          names=["conv_id", "repaired_sha256"])

    out: list[tuple] = []
    digest, empty, known, owner = hashlib.sha256(), True, False, None
    for conv_id, edit, role, text in _repaired(batches):
        if not edit:
            if known:
                out.append((owner, digest.hexdigest()))
                if len(out) == 1000:
                    yield batch(out)
                    out = []
            digest, empty, known, owner = hashlib.sha256(), True, True, conv_id
            continue
        digest.update(("" if empty else "\n").encode() + f"{role}:".encode())
        digest.update(text.encode())
        empty = False
    if known:
        out.append((owner, digest.hexdigest()))
    if out:
        yield batch(out)


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit and after it its rows in order."""
    none = F.lit(None)
    head = found.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), F.lit("").alias("role"),
                        none.cast("binary").alias("content"), none.cast("string").alias("text"),
                        F.lit(0).cast("long").alias("copies"), "audit")
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _content().alias("content"),
                                           "text", "copies", none.cast("string").alias("audit"))
    return (in_small_batches(head.unionByName(body)).repartition("conv_id")
            .sortWithinPartitions("conv_id", "kind", *_IN_ORDER[1:]).select("conv_id", "audit", "role", "text", "copies"))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows``: conv_id, place (from 1), edit (K, R or I), role and text."""
    return _with_audits(rows, audits(rows)).mapInArrow(_lines, "conv_id long, place long, edit string, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text without nulls but for ids and turns, copies).

    Returns ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``. A conversation whose
    rows all have 0 copies has zeros, an empty audit and the empty text's hash.

    Rows are taken by turn, null first, those of one turn by role and then the SHA-256 of their content.
    Null is a conversation of its own. A role that begins with another letter than
    s, u or a, or that is empty, can't be kept. Repeated rows are duplicates. The
    audit and the hash belong to a whole conversation, so one task reads it, in
    order, holding its runs and audit, but not its texts. Other columns are not
    read. An empty table gives an empty result.
    """
    found = audits(rows)
    hashes = _with_audits(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    hashes = hashes.withColumnRenamed("conv_id", "of")
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
