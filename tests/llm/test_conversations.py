"""Conversation trie and structure repair against brute force, with damaged, odd and very long conversations."""

import hashlib
import heapq
import math
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import conversation_repair as repair
from tessera.llm.conversation_trie import conversation_trie
from tessera.operators import ordered

SCHEMA = "conv_id long, turn long, role string, text string, rep int, part string, audit string"
SF = "/root/testdata/sf0.001"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _content(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _in_order(rows, null):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        by[c].append((turn, null if role is None else role, null if text is None else text))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), _content(*r[1:])))
    return by


def _plain_trie(rows, family=5, heads=9):
    by = _in_order([r for r in rows if r[0] is not None], "")
    plain = {c: [r[1:] for r in own] for c, own in by.items()}
    if family:
        whole = {}
        for c, own in plain.items():
            h = zlib.crc32(str(c).encode()) % heads
            whole[c] = plain.get(c - int(math.fmod(c, family)), [])[:h] + own[h:]
        plain = whole
    members = defaultdict(list)
    for c, turns in plain.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, leaves, saved = [], {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[p] for p in below)
        ends = ",".join(str(c) for c in sorted(members[path]) if len(plain[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]),
                    len(below), leaves[path], saved[path], _sha(ends)))
    return sorted(out, key=repr)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)


def _trie(spark, rows, **kw):
    return sorted((tuple(r) for r in conversation_trie(_frame(spark, rows), **kw).collect()), key=repr)


def _odd_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in (None, -7, -5, -1, 0, 3, 5, 7, 8, 9, 10, 11, 14, 10**15, -10**15):
        for _ in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([None, 0, 1, 1, 2, 3, 5, 9]), rng.choice([None, "", "user", "assistant", "system", "tool", "User"]),
                         rng.choice([None, "", "a.", "b", " \x0b", "é! ", "x?", "日本", ". \n"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_trie_of_odd_rows(spark, seed):
    rows = _odd_rows(seed)
    assert _trie(spark, rows) == _plain_trie(rows)
    assert _trie(spark, rows, family=None) == _plain_trie(rows, family=None)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _trie(spark, rows) == _plain_trie(rows)


def test_trie_of_many_copies_prefixes_and_a_long_conversation(spark, monkeypatch):
    from tessera.llm import conversation_trie as module
    rng = random.Random(1)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(1 + c % 4)]
    rows += [(1000 + c, t, "user", f"{rng.randrange(2)}") for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(5000, t, "user", f"turn {t}") for t in range(700)] + [(5001, t, "user", f"turn {t}") for t in range(650)]
    want = _plain_trie(rows)
    assert _trie(spark, rows) == want
    monkeypatch.setattr(module, "BLOCK", 7)  # lists of ids in many blocks
    assert _trie(spark, rows) == want


def test_an_empty_table_has_no_nodes(spark):
    assert _trie(spark, [(None, 1, "user", "x")]) == [] and conversation_trie(_frame(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0


def test_range_order_splits_a_long_key(spark):
    """Running values per key go over range partitions, so a key isn't bound to one."""
    df = spark.range(5000).selectExpr("1L AS conv_id", "id AS pos")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed, part, _ = ordered.in_range_order(df, [df["conv_id"], df["pos"]], "test")
        assert placed.select(part).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def _cheapest(symbols):
    """Uniform-cost search over (cost, audit), whole strings."""
    heap, done = [(0, "", 0, 0)], set()
    while True:
        cost, audit, at, state = heapq.heappop(heap)
        if at == len(symbols) and state in (0, 3):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        heapq.heappush(heap, (cost + 5, audit + "I", at, NEXT[state]))
        if at < len(symbols):
            initial, fault = symbols[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if fault != "gone":
                cut = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + 1 + cut, audit + "R", at + 1, NEXT[state]))
                if initial == "s" and state == 0:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, 1))
                elif initial == ("a" if state == 2 else "u"):
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, NEXT[state]))


def _runs(symbols):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1] = (s, runs[-1][1] + 1)
        else:
            runs.append((s, 1))
    return runs


SYMBOLS = [(i, f) for i in "suax" for f in ("ok", "truncated")] + [("x", "gone")]


def test_cheapest_edits_equal_a_full_search():
    rng = random.Random(5)
    for _ in range(4000):
        few = rng.sample(SYMBOLS, rng.randint(1, 4))
        symbols = [s for _ in range(rng.randint(0, 8)) for s in [rng.choice(few)] * rng.choice((1, 1, 1, 2, 3, 7))]
        assert repair.cheapest_edits(_runs(symbols)) == _cheapest(symbols), symbols
    for s in SYMBOLS:
        for n in range(40):
            assert repair.cheapest_edits([(s, n)] if n else []) == _cheapest([s] * n)


def test_long_runs_take_powers():
    cost, audit = repair.cheapest_edits([(("u", "ok"), 1_000_003), (("a", "truncated"), 500_001)])
    assert len(audit) == 1_500_004 and cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[e] for e in audit) + 5 * sum(
        e != "D" for e in audit[1_000_003:])
    # the same shape in small
    small = repair.cheapest_edits([(("u", "ok"), 103), (("a", "truncated"), 51)])
    assert small == _cheapest([("u", "ok")] * 103 + [("a", "truncated")] * 51)
    assert len(list(repair.power(("u", "ok"), 20)[0][3][1].leaves())) == 1 << 20


def test_ropes_compare_as_strings():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("DI") for _ in range(rng.randint(0, 9))) for _ in range(2))
        cut = [rng.randint(0, len(x)) for x in (a, b)]
        x, y = (repair.Rope(s[:k]) + repair.Rope(s[k:]) for s, k in zip((a, b), cut))
        got = repair.compare(x, y)
        assert "".join(x.leaves()) == a and (abs(got) == repair.DIFFERS) == (not a.startswith(b) and not b.startswith(a))
        assert got == (len(b) - len(a) if abs(got) != repair.DIFFERS else repair.DIFFERS * (1 if a > b else -1))


def _plain_repair(rows, damage=True):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        d, t = " " if c is None else str(c), " " if turn is None else str(turn)
        kind = zlib.crc32(f"{d}:{t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        by[c] += [(c, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, own in by.items():
        own = _in_order(own, " ")[c]
        turns = {t for t, _, _ in own if t is not None}
        seen, symbols, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not shown else "duplicate" if (role, text) in seen
                     else "truncated" if shown[-1] not in ".!?" else "ok")
            seen.add((role, text))
            if fault != "ok":
                count[fault] += 1
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "x", "gone" if fault in ("blank", "duplicate") else fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = _cheapest(symbols)
        lines, state, at = [], 0, iter(own)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(at)
            if edit == "D":
                continue
            state = 1 if edit == "K" and state == 0 and role[0] == "s" else NEXT[state]
            lines.append(f"{role if edit == 'K' else 'user' if state == 2 else 'assistant'}:{text}")
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), illegal, cost, audit,
                    _sha("\n".join(lines))))
    return sorted(out, key=repr)


def _repair(spark, rows):
    return sorted((tuple(r) for r in repair.repair_digests(repair.damaged(_frame(spark, rows))).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_repair_of_odd_rows(spark, seed):
    rows = _odd_rows(seed + 10)
    assert _repair(spark, rows) == _plain_repair(rows)


def test_repair_of_the_table_and_its_rows(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = _plain_repair(rows)
    assert _repair(spark, rows) == want
    lines = defaultdict(list)
    for r in repair.repaired_rows(repair.damaged(table)).orderBy("conv_id", "place").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
        assert r.place == len(lines[r.conv_id]) and r.edit in "KRI"
    assert {c: _sha("\n".join(x)) for c, x in lines.items()} == {w[0]: w[-1] for w in want if w[-1] != _sha("")}


def test_repair_of_a_very_long_conversation(spark):
    rng = random.Random(3)
    rows = [(1, k // 3, rng.choice(["user", "user", "assistant"]), rng.choice(["same.", f"t {k}.", f"cut {k}"])) for k in range(4000)]
    rows += [(2, 7, "user", "again and again.")] * 3000 + [(3, None, None, None)]
    assert _repair(spark, rows) == _plain_repair(rows)


def test_repair_of_an_empty_table_and_dropped_rows(spark):
    assert repair.repair_digests(repair.damaged(_frame(spark, [(1, 1, "a", "b")]).limit(0))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    assert _repair(spark, [(4, gone, "user", "x.")]) == [(4, 0, 0, 0, 0, 0, 0, "", _sha(""))]
    assert repair.repaired_rows(repair.damaged(_frame(spark, [(4, gone, "user", "x.")]))).count() == 0
