"""Schema linking (LNK-01..14): question text -> entities, tables, join paths, hints.

Per-row logic is native column expressions. The FK graph is fixed catalog
metadata (14 tables), so its k-hop reachability and shortest join paths are
tabulated once from the catalog and embedded as literal maps — the data-sized
work (one row per question) never leaves the executors.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.catalog import ERP_SCHEMA, FOREIGN_KEYS

# ---- fixed values: entity word -> tables (LNK-01/02), in listed order ----
ENTITY_TABLES = [
    ("project", ["SRM_PROJECTS", "PAC_MNT_PROJECTS"]),
    ("company", ["SRM_COMPANIES"]),
    ("contact", ["SRM_CONTACTS"]),
    ("resource", ["PAC_MNT_RESOURCES"]),
    ("staff", ["PROJSTAFF"]),
    ("contract", ["PROJCNTRTS"]),
    ("support", ["CLNTSUPP"]),
    ("client", ["CLNTSUPP", "CLNTRESPONS"]),
    ("revision", ["PROJEVISION"]),
    ("budget", ["PAC_MNT_PROJECTS"]),
    ("cost", ["PAC_MNT_PROJECTS", "PAC_MNT_RESOURCES"]),
]

# ---- fixed values: keyword groups for training-time table selection (LNK-03) ----
ALWAYS_TABLES = ["PAC_MNT_PROJECTS", "SRM_COMPANIES"]
KEYWORD_TABLE_GROUPS = [
    (["resource", "staff", "allocation", "team"], ["PAC_MNT_RESOURCES", "PROJSTAFF"]),
    (["contact", "email", "phone"], ["SRM_CONTACTS"]),
    (["contract", "agreement"], ["PROJCNTRTS"]),
]

# ---- fixed values: keyword -> tables for the basic selector (LNK-04) ----
BASIC_KEYWORD_TABLES = [
    ("project", ["SRM_PROJECTS", "PAC_MNT_PROJECTS", "PROJCNTRTS"]),
    ("company", ["SRM_COMPANIES"]),
    ("contact", ["SRM_CONTACTS"]),
    ("resource", ["PAC_MNT_RESOURCES"]),
    ("staff", ["PROJSTAFF"]),
    ("client", ["CLNTSUPP", "CLNTRESPONS"]),
]
BASIC_DEFAULT = "SRM_PROJECTS"

# ---- fixed values: compact table definitions used in schema context (LNK-05/06) ----
TABLE_DEFINITIONS = [
    ("PAC_MNT_PROJECTS", "Main projects table",
     ["Project_ID", "Project_Code", "Project_Name", "Status", "Budget", "Actual_Cost", "Start_Date", "End_Date",
      "Department", "Revenue"]),
    ("SRM_COMPANIES", "Companies and organizations", ["Company_ID", "Company_Code", "Company_Name", "Status"]),
    ("PROJSTAFF", "Project staff assignments",
     ["Staff_ID", "Project_Code", "Resource_Code", "Role", "Allocation_Percent", "Bill_Rate", "Cost_Rate", "Status"]),
    ("PAC_MNT_RESOURCES", "Resources and personnel",
     ["Resource_Code", "Resource_Name", "Resource_Type", "Email", "Capacity", "Cost_Rate", "Availability"]),
    ("PROJCNTRTS", "Project contracts",
     ["Contract_Number", "Project_Code", "Company_Code", "Contract_Value", "Contract_Type", "Start_Date", "End_Date",
      "Status"]),
    ("SRM_CONTACTS", "Company contacts", ["Contact_ID", "Company_ID", "Contact_Name", "Email", "Phone"]),
]
TABLE_RELATIONS = {
    "PAC_MNT_PROJECTS": ["PROJSTAFF", "PROJCNTRTS", "PROJEVISION"],
    "SRM_COMPANIES": ["SRM_CONTACTS", "PROJCNTRTS"],
    "PAC_MNT_RESOURCES": ["PROJSTAFF"],
}
JOIN_HINTS = (
    "Common Join Patterns:\n"
    "- Projects ↔ Staff: PAC_MNT_PROJECTS.Project_Code = PROJSTAFF.Project_Code\n"
    "- Projects ↔ Contracts: PAC_MNT_PROJECTS.Project_Code = PROJCNTRTS.Project_Code\n"
    "- Staff ↔ Resources: PROJSTAFF.Resource_Code = PAC_MNT_RESOURCES.Resource_Code\n"
    "- Companies ↔ Contacts: SRM_COMPANIES.Company_ID = SRM_CONTACTS.Company_ID\n"
    "- Companies ↔ Contracts: SRM_COMPANIES.Company_Code = PROJCNTRTS.Company_Code\n"
)

# ---- fixed values: business-context tags by table-name substring (LNK-10) ----
CONTEXT_TAGS = [("project", "project_management"), ("company", "company_data"),
                ("resource", "resource_allocation"), ("contract", "contract_management")]

# ---- fixed values: word groups -> operation (LNK-13), in order; time words -> tag (LNK-14) ----
OPERATION_WORDS = [(["list", "show", "get", "find"], "SELECT"), (["count", "total", "sum"], "AGGREGATE"),
                   (["create", "add", "insert"], "INSERT"), (["update", "change", "modify"], "UPDATE")]
TIME_WORDS = [("today", "current_day"), ("this month", "current_month"), ("this year", "current_year")]


# ----------------------------------------------------------------- graph tables

def relationship_edges() -> list[tuple[str, str]]:
    """LNK-07: undirected FK edges (both directions), sorted, self-loops kept once."""
    edges = set()
    for t, _, rt, _ in FOREIGN_KEYS:
        edges.add((t, rt))
        edges.add((rt, t))
    return sorted(edges)


def _adjacency() -> dict[str, list[str]]:
    adj: dict[str, list[str]] = {}
    for a, b in relationship_edges():
        adj.setdefault(a, []).append(b)
    return {k: sorted(v) for k, v in adj.items()}


def reach_within(depth: int) -> dict[str, list[str]]:
    """Tables reachable from each table by a walk of 1..depth FK hops."""
    adj = _adjacency()
    out = {}
    for t in adj:
        frontier, seen = {t}, set()
        for _ in range(depth):
            frontier = {n for f in frontier for n in adj.get(f, [])}
            seen |= frontier
        out[t] = sorted(seen)
    return out


def shortest_paths(max_nodes: int = 4) -> dict[str, str]:
    """Shortest FK path for every ordered table pair (``A|B`` -> ``A > X > B``),
    at most ``max_nodes`` tables; ties broken by table name (BFS over sorted neighbours)."""
    adj = _adjacency()
    out = {}
    for start in adj:
        q = deque([[start]])
        seen = {start}
        while q:
            path = q.popleft()
            if len(path) >= max_nodes:
                continue
            for n in adj.get(path[-1], []):
                if n in seen:
                    continue
                seen.add(n)
                p = path + [n]
                out[f"{start}|{n}"] = " > ".join(p)
                q.append(p)
    return out


def _map(d: dict[str, object]) -> Column:
    items = []
    for k, v in d.items():
        items.append(F.lit(k))
        items.append(F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
    return F.create_map(*items)


# ----------------------------------------------------------------- per-question columns

def _present(lq: Column, entity: str) -> Column:
    return lq.contains(entity) | lq.contains(entity + "s")


def identify_entities(query: Column) -> Column:
    """LNK-01: entity words found in the question; none -> ['project']."""
    lq = F.lower(F.coalesce(query, F.lit("")))
    found = F.array_compact(F.array(*[F.when(_present(lq, e), F.lit(e)) for e, _ in ENTITY_TABLES]))
    return F.when(F.size(found) == 0, F.array(F.lit("project"))).otherwise(found)


def entities_to_tables(query: Column, named: Column | None = None) -> Column:
    """LNK-02: ordered distinct tables of the identified entities; a row whose caller
    ``named`` tables gets those of them that the catalog has."""
    if named is not None:
        known = F.filter(named, lambda t: t.isin(*ERP_SCHEMA))
        return F.when(F.size(F.coalesce(named, F.array().cast("array<string>"))) > 0, known) \
            .otherwise(entities_to_tables(query))
    lq = F.lower(F.coalesce(query, F.lit("")))
    none = None
    for e, _ in ENTITY_TABLES:
        none = _present(lq, e) if none is None else (none | _present(lq, e))
    present = {e: (_present(lq, e) | ~none) if e == "project" else _present(lq, e) for e, _ in ENTITY_TABLES}
    seq = [(e, t) for e, ts in ENTITY_TABLES for t in ts]
    items = []
    for i, (e, t) in enumerate(seq):
        cond = present[e]
        for e2, t2 in seq[:i]:
            if t2 == t:
                cond = cond & ~present[e2]
        items.append(F.when(cond, F.lit(t)))
    return F.array_compact(F.array(*items))


def relevant_tables(query: Column) -> Column:
    """LNK-03: always projects + companies, plus keyword groups."""
    lq = F.lower(F.coalesce(query, F.lit("")))
    items = [F.lit(t) for t in ALWAYS_TABLES]
    for words, tables in KEYWORD_TABLE_GROUPS:
        hit = None
        for w in words:
            hit = lq.contains(w) if hit is None else (hit | lq.contains(w))
        items += [F.when(hit, F.lit(t)) for t in tables]
    return F.array_compact(F.array(*items))


# ---- fixed values: keyword -> table of the short variant (LNK-04), in order ----
SHORT_KEYWORD_TABLES = [("project", "PAC_MNT_PROJECTS"), ("company", "SRM_COMPANIES"), ("companies", "SRM_COMPANIES"),
                        ("contact", "SRM_CONTACTS"), ("staff", "PROJSTAFF"), ("resource", "PROJSTAFF")]


def relevant_tables_short(query: Column) -> Column:
    """LNK-04, second variant: keyword tables in order; none stays none."""
    lq = F.lower(F.coalesce(query, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(lq.contains(k), F.lit(t)) for k, t in SHORT_KEYWORD_TABLES])))


def relevant_tables_basic(query: Column) -> Column:
    """LNK-04: keyword table sets (sorted, distinct); default SRM_PROJECTS."""
    lq = F.lower(F.coalesce(query, F.lit("")))
    items = [F.when(lq.contains(k), F.lit(t)) for k, ts in BASIC_KEYWORD_TABLES for t in ts]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*items))))
    return F.when(F.size(found) == 0, F.array(F.lit(BASIC_DEFAULT))).otherwise(found)


def table_block(name: str, desc: str, cols: list[str]) -> str:
    text = f"Table: {name}\nDescription: {desc}\nColumns: {', '.join(cols)}\n"
    if name in TABLE_RELATIONS:
        text += f"Related tables: {', '.join(TABLE_RELATIONS[name])}\n"
    return text + "\n"


def schema_context(query: Column) -> Column:
    """LNK-05: schema text for the relevant tables plus the fixed join hints."""
    rel = relevant_tables(query)
    blocks = {n: table_block(n, d, c) for n, d, c in TABLE_DEFINITIONS}
    order = ALWAYS_TABLES + [t for _, ts in KEYWORD_TABLE_GROUPS for t in ts]
    parts = [F.when(F.array_contains(rel, t), F.lit(blocks[t])) for t in order if t in blocks]
    return F.concat_ws("", F.lit("Database Schema:\n\n"), *parts, F.lit(JOIN_HINTS))


def training_context() -> str:
    """LNK-06: schema text of every defined table (a constant)."""
    return "Complete Database Schema:\n\n" + "".join(table_block(n, d, c) for n, d, c in TABLE_DEFINITIONS)


def related_tables(tables: Column, depth: int = 2) -> Column:
    """LNK-08: ``T: u, v`` for every table with related tables among ``tables``."""
    reach = _map(reach_within(depth))

    def one(t):
        rel = F.filter(tables, lambda u: F.coalesce(F.array_contains(F.try_element_at(reach, t), u), F.lit(False)))
        return F.when(F.size(rel) > 0, F.concat(t, F.lit(": "), F.array_join(rel, ", ")))
    return F.array_compact(F.transform(tables, one))


def join_paths(tables: Column) -> Column:
    """LNK-09: shortest path for each unordered pair of ``tables`` (in order)."""
    paths = _map(shortest_paths())
    pairs = F.flatten(F.transform(tables, lambda t, i: F.transform(
        F.slice(tables, i + 2, F.size(tables)), lambda u: F.concat(t, F.lit("|"), u))))
    return F.array_compact(F.transform(pairs, lambda k: F.try_element_at(paths, k)))


def business_context(tables: Column) -> Column:
    """LNK-10: ``tag=table`` (last table per tag) for the tags that fire."""
    def tag_of(t):
        lt = F.lower(t)
        out = None
        for sub, tag in CONTEXT_TAGS:
            out = F.when(lt.contains(sub), F.lit(tag)) if out is None else out.when(lt.contains(sub), F.lit(tag))
        return out
    items = []
    for _, tag in CONTEXT_TAGS:
        last = F.try_element_at(_filter_tag(tables, tag_of, tag), F.lit(-1))
        items.append(F.when(last.isNotNull(), F.concat(F.lit(tag + "="), last)))
    return F.array_compact(F.array(*items))


def _filter_tag(tables: Column, tag_of, tag: str) -> Column:
    want = F.lit(tag)
    return F.filter(tables, lambda t: F.coalesce(tag_of(t) == want, F.lit(False)))


def query_hints(query: Column, n_tables: Column) -> Column:
    """LNK-11: join / recency / status / aggregation hints (their texts and words are fixed values)."""
    lq = F.lower(F.coalesce(query, F.lit("")))
    return F.array_compact(F.array(
        F.when(n_tables > 1, F.concat(F.lit("Consider joining "), n_tables.cast("string"), F.lit(" tables"))),
        F.when(lq.contains("recent") | lq.contains("latest"), "Add date filters for recent data"),
        F.when(lq.contains("active"), "Filter by status = 'Active'"),
        F.when(lq.contains("count") | lq.contains("total") | lq.contains("sum") | lq.contains("average"),
               "Use appropriate aggregation functions")))


def linking_confidence(n_tables: Column, n_paths: Column, n_tags: Column) -> Column:
    """LNK-12: 0.5 + min(0.1 x tables, 0.3) + 0.1 (paths) + 0.1 (tags), capped at 1."""
    s = (F.lit(0.5) + F.when(n_tables > 0, F.least(n_tables * 0.1, F.lit(0.3))).otherwise(0.0)
         + F.when(n_paths > 0, 0.1).otherwise(0.0) + F.when(n_tags > 0, 0.1).otherwise(0.0))
    return F.least(F.lit(1.0), s)


def operation_type(query: Column) -> Column:
    """LNK-13: first matching word group wins; default SELECT."""
    lq = F.lower(F.coalesce(query, F.lit("")))
    out = None
    for words, op in OPERATION_WORDS:
        hit = None
        for w in words:
            hit = lq.contains(w) if hit is None else (hit | lq.contains(w))
        out = F.when(hit, F.lit(op)) if out is None else out.when(hit, F.lit(op))
    return out.otherwise("SELECT")


def time_context(query: Column) -> Column:
    """LNK-14: today / this month / this year (else NULL)."""
    lq = F.lower(F.coalesce(query, F.lit("")))
    out = None
    for w, tag in TIME_WORDS:
        out = F.when(lq.contains(w), F.lit(tag)) if out is None else out.when(lq.contains(w), F.lit(tag))
    return out
