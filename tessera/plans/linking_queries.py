"""LNK-01..14 over the distinct questions of the pair table, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linking as L
from ..operators.erp import rounded
from ..sources.catalog import ERP_SCHEMA, FOREIGN_KEYS
from .registry import query
from .sqltext_sql import q

# --------------------------------------------------------------- DuckDB twins


def _lq(c: str) -> str:
    return f"lower(coalesce({c}, ''))"


def _any(lq: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({lq}, {q(w)})" for w in words) + ")"


def _compact(items: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CAST({i} AS VARCHAR)" for i in items) + "], lambda x: x IS NOT NULL)"


def _present(lq: str, e: str) -> str:
    return f"(contains({lq}, {q(e)}) OR contains({lq}, {q(e + 's')}))"


def x_entities(c: str) -> str:
    lq = _lq(c)
    found = _compact([f"(CASE WHEN {_present(lq, e)} THEN {q(e)} END)" for e, _ in L.ENTITY_TABLES])
    return f"(CASE WHEN len({found}) = 0 THEN ['project'] ELSE {found} END)"


def x_entity_tables(c: str) -> str:
    lq = _lq(c)
    none = "(NOT (" + " OR ".join(_present(lq, e) for e, _ in L.ENTITY_TABLES) + "))"
    present = {e: (f"({_present(lq, e)} OR {none})" if e == "project" else _present(lq, e)) for e, _ in L.ENTITY_TABLES}
    seq = [(e, t) for e, ts in L.ENTITY_TABLES for t in ts]
    items = []
    for i, (e, t) in enumerate(seq):
        cond = present[e]
        for e2, t2 in seq[:i]:
            if t2 == t:
                cond = f"({cond} AND NOT {present[e2]})"
        items.append(f"(CASE WHEN {cond} THEN {q(t)} END)")
    return _compact(items)


def x_relevant(c: str) -> str:
    lq = _lq(c)
    items = [q(t) for t in L.ALWAYS_TABLES]
    for words, tables in L.KEYWORD_TABLE_GROUPS:
        items += [f"(CASE WHEN {_any(lq, words)} THEN {q(t)} END)" for t in tables]
    return _compact(items)


def x_relevant_basic(c: str) -> str:
    lq = _lq(c)
    found = ("list_sort(list_distinct(" + _compact([f"(CASE WHEN contains({lq}, {q(k)}) THEN {q(t)} END)"
                                                     for k, ts in L.BASIC_KEYWORD_TABLES for t in ts]) + "))")
    return f"(CASE WHEN len({found}) = 0 THEN [{q(L.BASIC_DEFAULT)}] ELSE {found} END)"


def x_schema_context(c: str) -> str:
    rel = x_relevant(c)
    blocks = {n: L.table_block(n, d, cols) for n, d, cols in L.TABLE_DEFINITIONS}
    order = L.ALWAYS_TABLES + [t for _, ts in L.KEYWORD_TABLE_GROUPS for t in ts]
    parts = [f"(CASE WHEN list_contains({rel}, {q(t)}) THEN {q(blocks[t])} END)" for t in order if t in blocks]
    return "concat_ws('', " + ", ".join([q("Database Schema:\n\n"), *parts, q(L.JOIN_HINTS)]) + ")"


def _map_sql(d: dict) -> str:
    def val(v):
        return "[" + ", ".join(q(x) for x in v) + "]" if isinstance(v, list) else q(v)
    return "MAP {" + ", ".join(f"{q(k)}: {val(v)}" for k, v in d.items()) + "}"


def x_related(tables: str, depth: int = 2) -> str:
    reach = _map_sql(L.reach_within(depth))
    one = (f"CASE WHEN len(list_filter({tables}, lambda u: coalesce(list_contains({reach}[t], u), FALSE))) > 0 "
           f"THEN t || ': ' || array_to_string(list_filter({tables}, lambda u: coalesce(list_contains({reach}[t], u), "
           f"FALSE)), ', ') END")
    return f"list_filter(list_transform({tables}, lambda t: {one}), lambda x: x IS NOT NULL)"


def x_join_paths(tables: str) -> str:
    paths = _map_sql(L.shortest_paths())
    pairs = f"flatten(list_transform({tables}, lambda t, i: list_transform({tables}[i+1:], lambda u: t || '|' || u)))"
    return f"list_filter(list_transform({pairs}, lambda k: {paths}[k]), lambda x: x IS NOT NULL)"


def x_business(tables: str) -> str:
    def tag_of(t):
        return "(CASE " + " ".join(f"WHEN contains(lower({t}), {q(s)}) THEN {q(g)}" for s, g in L.CONTEXT_TAGS) + " END)"
    items = []
    for _, tag in L.CONTEXT_TAGS:
        last = f"list_filter({tables}, lambda t: coalesce({tag_of('t')} = {q(tag)}, FALSE))[-1]"
        items.append(f"(CASE WHEN {last} IS NOT NULL THEN {q(tag + '=')} || {last} END)")
    return _compact(items)


def x_hints(c: str, n: str) -> str:
    lq = _lq(c)
    return _compact([
        f"(CASE WHEN {n} > 1 THEN 'Consider joining ' || CAST({n} AS VARCHAR) || ' tables' END)",
        f"(CASE WHEN {_any(lq, ['recent', 'latest'])} THEN 'Add date filters for recent data' END)",
        f"(CASE WHEN contains({lq}, 'active') THEN 'Filter by status = ''Active''' END)",
        f"(CASE WHEN {_any(lq, ['count', 'total', 'sum', 'average'])} THEN 'Use appropriate aggregation functions' END)"])


def x_operation(c: str) -> str:
    lq = _lq(c)
    return "(CASE " + " ".join(f"WHEN {_any(lq, ws)} THEN {q(op)}" for ws, op in L.OPERATION_WORDS) + " ELSE 'SELECT' END)"


def x_time(c: str) -> str:
    lq = _lq(c)
    return "(CASE " + " ".join(f"WHEN contains({lq}, {q(w)}) THEN {q(t)}" for w, t in L.TIME_WORDS) + " END)"


# --------------------------------------------------------------- queries

_QS = "WITH d AS (SELECT DISTINCT query FROM pairs)"


def _questions(v):
    return v.pairs.select("query").distinct()


@query("lnk_01", f"{_QS} SELECT query, array_to_string({x_entities('query')}, ' | ') AS entities FROM d")
def lnk_01(v):
    return _questions(v).select("query", F.array_join(L.identify_entities(F.col("query")), " | ").alias("entities"))


@query("lnk_02", f"{_QS} SELECT query, array_to_string({x_entity_tables('query')}, ' | ') AS tables FROM d")
def lnk_02(v):
    return _questions(v).select("query", F.array_join(L.entities_to_tables(F.col("query")), " | ").alias("tables"))


@query("lnk_02_named", f"""{_QS}, n AS (SELECT query, CASE WHEN length(query) % 2 = 0 THEN ['PROJSTAFF', 'NO_SUCH_TABLE', 'SRM_CONTACTS'] END
AS named FROM d) SELECT query, array_to_string(CASE WHEN named IS NULL THEN {x_entity_tables('query')}
ELSE list_filter(named, lambda t: t IN ({", ".join(q(t) for t in ERP_SCHEMA)})) END, ' | ') AS tables FROM n""")
def lnk_02_named(v):
    """LNK-02 with tables that the caller names for some questions."""
    named = F.when(F.length("query") % 2 == 0, F.array(*[F.lit(t) for t in ("PROJSTAFF", "NO_SUCH_TABLE", "SRM_CONTACTS")]))
    return _questions(v).select("query", F.array_join(L.entities_to_tables(F.col("query"), named), " | ").alias("tables"))


@query("lnk_03", f"{_QS} SELECT query, array_to_string({x_relevant('query')}, ' | ') AS tables FROM d")
def lnk_03(v):
    return _questions(v).select("query", F.array_join(L.relevant_tables(F.col("query")), " | ").alias("tables"))


@query("lnk_04", f"{_QS} SELECT query, array_to_string({x_relevant_basic('query')}, ' | ') AS tables FROM d")
def lnk_04(v):
    return _questions(v).select("query", F.array_join(L.relevant_tables_basic(F.col("query")), " | ").alias("tables"))


@query("lnk_04_short", f"""{_QS} SELECT query, array_to_string(list_filter([
CASE WHEN contains(lower(query), 'project') THEN 'PAC_MNT_PROJECTS' END,
CASE WHEN contains(lower(query), 'company') OR contains(lower(query), 'companies') THEN 'SRM_COMPANIES' END,
CASE WHEN contains(lower(query), 'contact') THEN 'SRM_CONTACTS' END,
CASE WHEN contains(lower(query), 'staff') OR contains(lower(query), 'resource') THEN 'PROJSTAFF' END],
lambda x: x IS NOT NULL), ' | ') AS tables FROM d""")
def lnk_04_short(v):
    return _questions(v).select("query", F.array_join(L.relevant_tables_short(F.col("query")), " | ").alias("tables"))


@query("lnk_05", f"{_QS} SELECT query, {x_schema_context('query')} AS schema_context FROM d")
def lnk_05(v):
    return _questions(v).select("query", L.schema_context(F.col("query")).alias("schema_context"))


_T = f"WITH d AS (SELECT DISTINCT query FROM pairs), t AS (SELECT query, {x_entity_tables('query')} AS tables FROM d)"


def _with_tables(v):
    return _questions(v).select("query", L.entities_to_tables(F.col("query")).alias("tables"))


@query("lnk_07", f"""{_T}, e AS (SELECT DISTINCT query, unnest(tables) AS src FROM t)
SELECT e.query, e.src, x.dst FROM e JOIN (SELECT * FROM (VALUES {", ".join(f"({q(a)}, {q(b)})" for a, b in L.relationship_edges())}) v(src, dst)) x
ON e.src = x.src""")
def lnk_07(v):
    """Undirected FK edges leaving each question's tables (edge list is catalog-sized, broadcast)."""
    spark = v.spark
    edges = F.broadcast(spark.createDataFrame(L.relationship_edges(), "src string, dst string"))
    e = _with_tables(v).select("query", F.explode(F.array_distinct("tables")).alias("src"))
    return e.join(edges, "src").select("query", "src", "dst")


# the graph in SQL, from the foreign keys themselves
_GRAPH = f"""fk(a, b) AS (VALUES {", ".join(f"({q(t)}, {q(rt)})" for t, _, rt, _ in FOREIGN_KEYS)}),
edges AS (SELECT a AS src, b AS dst FROM fk UNION SELECT b, a FROM fk),
d AS (SELECT DISTINCT query FROM pairs), t AS (SELECT query, {x_entity_tables('query')} AS tables FROM d),
tt AS (SELECT query, unnest(tables) AS tab, generate_subscripts(tables, 1) AS i FROM t)"""


@query("lnk_08", f"""WITH RECURSIVE {_GRAPH},
walk AS (SELECT src, dst, 1 AS hops FROM edges UNION SELECT w.src, e.dst, hops + 1 FROM walk w JOIN edges e ON w.dst = e.src
  WHERE hops < 2),
reach AS (SELECT DISTINCT src, dst FROM walk),
one AS (SELECT x.query, x.i, x.tab || ': ' || string_agg(y.tab, ', ' ORDER BY y.i) AS line
  FROM tt x JOIN tt y ON x.query = y.query JOIN reach r ON r.src = x.tab AND r.dst = y.tab GROUP BY x.query, x.i, x.tab)
SELECT t.query, coalesce((SELECT string_agg(line, ' | ' ORDER BY i) FROM one WHERE one.query = t.query), '') AS related FROM t""")
def lnk_08(v):
    return _with_tables(v).select("query", F.array_join(L.related_tables(F.col("tables")), " | ").alias("related"))


@query("lnk_09", f"""WITH RECURSIVE {_GRAPH},
walk AS (SELECT src, dst, [src, dst] AS path FROM edges WHERE src <> dst UNION ALL
  SELECT w.src, e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON w.dst = e.src
  WHERE len(w.path) < 4 AND NOT list_contains(w.path, e.dst)),
best AS (SELECT src, dst, path FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY len(path), path) AS rn FROM walk)
  WHERE rn = 1),
one AS (SELECT x.query, x.i, y.i AS j, array_to_string(b.path, ' > ') AS line
  FROM tt x JOIN tt y ON x.query = y.query AND x.i < y.i JOIN best b ON b.src = x.tab AND b.dst = y.tab)
SELECT t.query, coalesce((SELECT string_agg(line, ' | ' ORDER BY i, j) FROM one WHERE one.query = t.query), '') AS join_paths
FROM t""")
def lnk_09(v):
    return _with_tables(v).select("query", F.array_join(L.join_paths(F.col("tables")), " | ").alias("join_paths"))


@query("lnk_10", f"{_T} SELECT query, array_to_string({x_business('tables')}, ' | ') AS business_context FROM t")
def lnk_10(v):
    return _with_tables(v).select("query", F.array_join(L.business_context(F.col("tables")), " | ")
                                  .alias("business_context"))


@query("lnk_11", f"{_T} SELECT query, array_to_string({x_hints('query', 'len(tables)')}, ' | ') AS hints FROM t")
def lnk_11(v):
    return _with_tables(v).select("query", F.array_join(L.query_hints(F.col("query"), F.size("tables")), " | ")
                                  .alias("hints"))


@query("lnk_12", f"""{_T} SELECT query, floor(least(1.0, 0.5 + CASE WHEN len(tables) > 0 THEN least(len(tables) * 0.1, 0.3)
ELSE 0.0 END + CASE WHEN len({x_join_paths('tables')}) > 0 THEN 0.1 ELSE 0.0 END
+ CASE WHEN len({x_business('tables')}) > 0 THEN 0.1 ELSE 0.0 END) * 1000000 + 0.5) / 1000000 AS confidence FROM t""")
def lnk_12(v):
    t = _with_tables(v)
    conf = L.linking_confidence(F.size("tables"), F.size(L.join_paths(F.col("tables"))),
                                F.size(L.business_context(F.col("tables"))))
    return t.select("query", rounded(conf, 6).alias("confidence"))


@query("lnk_13", f"{_QS} SELECT query, {x_operation('query')} AS operation_type FROM d")
def lnk_13(v):
    return _questions(v).select("query", L.operation_type(F.col("query")).alias("operation_type"))


@query("lnk_14", f"{_QS} SELECT query, {x_time('query')} AS time_context FROM d")
def lnk_14(v):
    return _questions(v).select("query", L.time_context(F.col("query")).alias("time_context"))
