"""DuckDB twins of :mod:`tessera.functions.textfix` (oracle text only)."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import textfix as TF
from .sqltext_sql import q

EMPTY = "[]::VARCHAR[]"


def strip(c: str) -> str:
    return f"trim({c}, {q(TF.WS_CHARS)})"


def compact(items: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CAST({i} AS VARCHAR)" for i in items) + "], lambda x: x IS NOT NULL)"


def split_output(text: str) -> dict[str, str]:
    t = f"coalesce({text}, '')"
    has = f"(contains({t}, '<think>') AND contains({t}, '</think>'))"
    io, ic = f"instr({t}, '<think>')", f"instr({t}, '</think>')"
    reasoning = f"(CASE WHEN {has} THEN {strip(f'substring({t}, {io} + 7, greatest({ic} - {io} - 7, 0))')} ELSE '' END)"
    after = f"(CASE WHEN {has} THEN substring({t}, {ic} + 8, 1000000000) ELSE {t} END)"
    s = strip(after)
    for tok in TF.CHAT_TOKENS:
        s = strip(f"replace({s}, {q(tok)}, '')")
    s = f"(CASE WHEN starts_with(upper({s}), 'SQL:') THEN {strip(f'substring({s}, 5, 1000000000)')} ELSE {s} END)"
    return {"sql": s, "reasoning": reasoning}


def keyword_position(s: str) -> str:
    u = f"upper({s})"
    return ("list_min(list_filter([" + ", ".join(f"instr({u}, {q(k)})" for k in TF.STATEMENT_KEYWORDS)
            + "], lambda x: x > 0))")


def line_start_from(s: str, pos: str) -> str:
    head = f"regexp_extract(substring({s}, 1, {pos} - 1), '([^\n]*)$', 1)"
    return f"coalesce(substring({s}, {pos} - length({head}), 1000000000), '')"


def statement_start(s: str) -> str:
    return line_start_from(s, keyword_position(s))


def statement_block(start: str) -> str:
    m_semi = f"regexp_extract({start}, {q(TF.SEMI_LINE)}, 1)"
    m_blank = f"regexp_extract({start}, {q(TF.BLANK_LINE)}, 1)"
    return strip(f"(CASE WHEN {m_semi} <> '' AND ({m_blank} = '' OR length({m_semi}) <= length({m_blank})) "
                 f"THEN {m_semi} WHEN {m_blank} <> '' THEN {m_blank} ELSE {start} END)")


def sql_candidate(text: str) -> str:
    t = f"coalesce({text}, '')"
    s0 = split_output(t)["sql"]
    return f"(CASE WHEN {s0} = '' THEN {t} ELSE {s0} END)"


def extract_from(s: str, start: str) -> str:
    fence = f"instr(lower({s}), '```sql')"
    body = f"substring({s}, {fence} + 6, 1000000000)"
    close = f"instr({body}, '```')"
    fenced = strip(f"(CASE WHEN {close} > 0 THEN substring({body}, 1, {close} - 1) ELSE {body} END)")
    kws = "|".join(TF.STATEMENT_KEYWORDS)
    return (f"(CASE WHEN {fence} > 0 THEN {fenced} WHEN regexp_matches(upper({s}), {q(kws)}) "
            f"THEN {statement_block(start)} ELSE '' END)")


def response_after_prompt(text: str, prompt: str) -> str:
    t = f"coalesce({text}, '')"
    return strip(f"substring({t}, length(coalesce({prompt}, '')) + 1, 1000000000)")


def line_kinds(resp: str) -> str:
    led = rf"(?is)^\s*({'|'.join(TF.STATEMENT_KEYWORDS)})"
    return (f"array_to_string(list_transform(string_split({resp}, chr(10)), lambda x: CASE WHEN regexp_matches(x, {q(led)}) "
            f"THEN 'k' WHEN {strip('x')} = '' THEN 'b' WHEN ends_with({strip('x')}, ';') THEN 'e' ELSE 'o' END), '')")


def extract_from_response(resp: str, kinds: str) -> str:
    before = f"length(regexp_extract({kinds}, '^([^k]*)k', 1))"
    taken = f"length(regexp_extract({kinds}, '^[^k]*(k[ko]*e?)', 1))"
    sql = strip(f"array_to_string(string_split({resp}, chr(10))[{before} + 1:{before} + {taken}], chr(10))")
    fallback = strip(f"split_part({resp}, '<|im_end|>', 1)")
    return f"(CASE WHEN {sql} = '' THEN {fallback} ELSE {sql} END)"


def fix_table_names(sql: str) -> dict[str, str]:
    s = f"coalesce({sql}, '')"
    ordered = sorted(TF.TABLE_MAPPINGS, key=lambda m: len(m[0]), reverse=True)
    out = s
    for generic, domain in ordered:
        for kw in ("FROM", "JOIN", "INTO", "UPDATE"):
            out = f"regexp_replace({out}, {q(TF.table_pattern(kw, generic))}, {q(kw + ' ' + domain)}, 'g')"
    fired = [f"(CASE WHEN regexp_matches({s}, {q(rf'(?i)\b(FROM|JOIN|INTO|UPDATE)\s+{g}\b')}) "
             f"THEN {q(f'Replaced {chr(39)}{g}{chr(39)} with {chr(39)}{d}{chr(39)}')} END)" for g, d in ordered]
    return {"sql": out, "corrections": compact(fired)}


def fix_column_case(sql: str) -> dict[str, str]:
    s = f"coalesce({sql}, '')"
    out = s
    fired = []
    for generic, proper in TF.COLUMN_MAPPINGS:
        pat = rf"(?i)\b{generic}\b"
        cond = f"(NOT contains({s}, {q(proper)}) AND contains(lower({s}), {q(generic)}) AND regexp_matches({s}, {q(pat)}))"
        out = f"regexp_replace({out}, CASE WHEN {cond} THEN {q(pat)} ELSE {q(TF.NEVER)} END, {q(proper)}, 'g')"
        fired.append(f"(CASE WHEN {cond} THEN {q(f'Corrected column {chr(39)}{generic}{chr(39)} to {chr(39)}{proper}{chr(39)}')} END)")
    return {"sql": out, "corrections": compact(fired)}


def uses_domain_tables(sql: str) -> str:
    u = f"upper(coalesce({sql}, ''))"
    return "(" + " OR ".join(f"contains({u}, {q(t)})" for t in P.DOMAIN_TABLES) + ")"


def tables_used(sql: str) -> str:
    u = f"upper(coalesce({sql}, ''))"
    return compact([f"(CASE WHEN contains({u}, {q(t)}) THEN {q(t)} END)" for t in P.DOMAIN_TABLES])


def fix_from_question(sql: str, query: str) -> dict[str, str]:
    s = f"coalesce({sql}, '')"
    ql = f"lower(coalesce({query}, ''))"
    generic = f"regexp_extract({s}, {q(r'(?i)SELECT\s+\*\s+FROM\s+(\w+)')}, 1)"
    dom = ", ".join(q(t) for t in P.DOMAIN_TABLES)
    usable = f"({generic} <> '' AND upper({generic}) NOT IN ({dom}))"
    table = "(CASE " + " ".join(f"WHEN contains({ql}, {q(kw)}) AND NOT contains({s}, {q(t)}) THEN {q(t)}"
                                for kw, t in TF.QUESTION_TABLE_HINTS) + " END)"
    needle = f"('FROM ' || {generic})"
    pos = f"instr({s}, {needle})"
    replaced = (f"(CASE WHEN {pos} > 0 THEN substring({s}, 1, {pos} - 1) || 'FROM ' || {table} || "
                f"substring({s}, {pos} + length({needle}), 1000000000) ELSE {s} END)")
    applies = f"({usable} AND {table} IS NOT NULL)"
    return {"sql": f"(CASE WHEN {applies} THEN {replaced} ELSE {s} END)",
            "corrections": f"(CASE WHEN {applies} THEN ['Context-based: replaced ''' || {generic} || ''' with ''' || {table} || ''''] ELSE {EMPTY} END)"}


def suggest_improvements(sql: str, query: str) -> str:
    s = f"coalesce({sql}, '')"
    su = f"upper({s})"
    ql = f"lower(coalesce({query}, ''))"
    return compact([
        f"(CASE WHEN NOT {uses_domain_tables(s)} THEN 'Use domain-specific table names (PAC_MNT_PROJECTS, SRM_COMPANIES, etc.)' END)",
        f"(CASE WHEN contains({ql}, 'active') AND NOT contains({s}, 'Status = ''Active''') THEN 'Consider adding Status = ''Active'' filter' END)",
        f"(CASE WHEN contains({ql}, 'budget') AND NOT contains({s}, 'Budget') THEN 'Include Budget column or filter' END)",
        f"(CASE WHEN contains({ql}, 'count') AND NOT contains({su}, 'COUNT') THEN 'Use COUNT() aggregate function' END)",
        f"(CASE WHEN (contains({ql}, 'group') OR contains({ql}, 'per')) AND NOT contains({su}, 'GROUP BY') THEN 'Consider using GROUP BY clause' END)",
        f"(CASE WHEN (contains({ql}, 'join') OR contains({ql}, 'with their')) AND NOT contains({su}, 'JOIN') THEN 'Consider using JOIN to combine tables' END)",
    ])


def report(original: str, processed: str, corrections: str) -> dict[str, str]:
    o = f"coalesce({original}, '')"
    was = f"({processed} <> {o})"
    uses = uses_domain_tables(processed)
    conf = (f"greatest(0.1, 1.0 - (CASE WHEN {was} THEN len({corrections}) * 0.1 ELSE 0.0 END) "
            f"- (CASE WHEN {uses} THEN 0.0 ELSE 0.5 END))")
    return {"processed_sql": processed, "was_corrected": was, "corrections": corrections,
            "uses_domain_tables": uses, "confidence": conf}
