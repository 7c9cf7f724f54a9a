"""Model-output extraction (EXT-01..03) and SQL repair (FIX-01..06) as Column functions.

Written with built-in string/regex expressions only (no Python per row).
Python's ``str.strip()`` is reproduced with a whitespace regex because Spark's
``trim`` removes spaces only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

# ---- fixed values: generic -> domain table names (FIX-01), in listed order ----
TABLE_MAPPINGS = [
    ("projects", "PAC_MNT_PROJECTS"), ("project", "PAC_MNT_PROJECTS"), ("proj", "PAC_MNT_PROJECTS"),
    ("project_table", "PAC_MNT_PROJECTS"), ("projects_table", "PAC_MNT_PROJECTS"),
    ("pac_projects", "PAC_MNT_PROJECTS"),
    ("companies", "SRM_COMPANIES"), ("company", "SRM_COMPANIES"), ("comp", "SRM_COMPANIES"),
    ("company_table", "SRM_COMPANIES"), ("companies_table", "SRM_COMPANIES"), ("organizations", "SRM_COMPANIES"),
    ("organisation", "SRM_COMPANIES"), ("srm_company", "SRM_COMPANIES"),
    ("staff", "PROJSTAFF"), ("project_staff", "PROJSTAFF"), ("staff_table", "PROJSTAFF"),
    ("assignments", "PROJSTAFF"), ("staff_assignments", "PROJSTAFF"), ("project_assignments", "PROJSTAFF"),
    ("allocations", "PROJSTAFF"),
    ("contracts", "PROJCNTRTS"), ("contract", "PROJCNTRTS"), ("project_contracts", "PROJCNTRTS"),
    ("contract_table", "PROJCNTRTS"), ("agreements", "PROJCNTRTS"),
    ("resources", "PAC_MNT_RESOURCES"), ("resource", "PAC_MNT_RESOURCES"), ("resource_table", "PAC_MNT_RESOURCES"),
    ("pac_resources", "PAC_MNT_RESOURCES"), ("personnel", "PAC_MNT_RESOURCES"), ("employees", "PAC_MNT_RESOURCES"),
    ("contacts", "SRM_CONTACTS"), ("contact", "SRM_CONTACTS"), ("contact_table", "SRM_CONTACTS"),
    ("srm_contact", "SRM_CONTACTS"), ("company_contacts", "SRM_CONTACTS"),
]

# ---- fixed values: lower-case column name -> schema spelling (FIX-02), in order ----
COLUMN_MAPPINGS = [
    ("project_id", "Project_ID"), ("project_code", "Project_Code"), ("project_name", "Project_Name"),
    ("status", "Status"), ("budget", "Budget"), ("actual_cost", "Actual_Cost"), ("start_date", "Start_Date"),
    ("end_date", "End_Date"), ("department", "Department"), ("revenue", "Revenue"),
    ("company_id", "Company_ID"), ("company_code", "Company_Code"), ("company_name", "Company_Name"),
    ("staff_id", "Staff_ID"), ("resource_code", "Resource_Code"), ("allocation_percent", "Allocation_Percent"),
    ("bill_rate", "Bill_Rate"), ("cost_rate", "Cost_Rate"), ("role", "Role"),
    ("contract_number", "Contract_Number"), ("contract_value", "Contract_Value"), ("contract_type", "Contract_Type"),
    ("resource_name", "Resource_Name"), ("resource_type", "Resource_Type"), ("email", "Email"),
    ("capacity", "Capacity"), ("availability", "Availability"),
    ("contact_id", "Contact_ID"), ("contact_name", "Contact_Name"), ("phone", "Phone"),
]

# ---- fixed values: question keyword -> table (FIX-04), in order ----
QUESTION_TABLE_HINTS = [
    ("project", "PAC_MNT_PROJECTS"), ("company", "SRM_COMPANIES"), ("companies", "SRM_COMPANIES"),
    ("staff", "PROJSTAFF"), ("resource", "PAC_MNT_RESOURCES"), ("contract", "PROJCNTRTS"),
    ("contact", "SRM_CONTACTS"),
]

STATEMENT_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"]
CHAT_TOKENS = ["<|im_end|>", "<|im_start|>"]
NEVER = r"\b\B"  # a pattern that matches nowhere


WS_CHARS = " \t\n\r\f\x0b"  # ASCII whitespace removed by str.strip()


def strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace (``btrim``, no regex)."""
    return F.btrim(c, F.lit(WS_CHARS))


# ----------------------------------------------------------------- EXT

def think_parts(text: Column) -> dict[str, Column]:
    """EXT-01 step 1: reasoning between the think tags and the raw text after them."""
    t = F.coalesce(text, F.lit(""))
    has = t.contains("<think>") & t.contains("</think>")
    i_open = F.instr(t, "<think>")
    i_close = F.instr(t, "</think>")
    reasoning = F.when(has, strip(F.substring(t, i_open + 7, F.greatest(i_close - i_open - 7, F.lit(0)))))
    after = F.when(has, F.substr(t, i_close + 8)).otherwise(t)
    return {"after": after, "reasoning": F.coalesce(reasoning, F.lit(""))}


def clean_sql(after: Column) -> Column:
    """EXT-01 step 2: strip, drop chat tokens, drop a leading ``SQL:``."""
    s = strip(after)
    for tok in CHAT_TOKENS:
        s = strip(F.replace(s, F.lit(tok), F.lit("")))
    return s


def drop_sql_prefix(s: Column) -> Column:
    return F.when(F.upper(s).startswith("SQL:"), strip(F.substr(s, F.lit(5)))).otherwise(s)


def split_output(text: Column) -> dict[str, Column]:
    """EXT-01: (sql, reasoning) from model text.

    Reasoning is the text between the first ``<think>`` and the first
    ``</think>``; the SQL is what follows ``</think>``, minus chat tokens and a
    leading ``SQL:``. (``tessera.operators.textops`` projects the steps in
    layers so each is evaluated once per row.)
    """
    p = think_parts(text)
    return {"sql": drop_sql_prefix(clean_sql(p["after"])), "reasoning": p["reasoning"]}


SEMI_LINE = r"(?s)^(.*?;[^\n]*)"
BLANK_LINE = r"(?s)^(.*?)\n[ \t\r\f]*(?:\n|$)"




def keyword_position(s: Column) -> Column:
    """1-based position of the first statement keyword (any case), NULL when none.

    Plain ``instr`` calls combined with array functions: no regex and no CASE,
    so each ``instr`` is evaluated once.
    """
    u = F.upper(s)
    return F.array_min(F.array_remove(F.array(*[F.instr(u, k) for k in STATEMENT_KEYWORDS]), 0))


def line_start_from(s: Column, pos: Column) -> Column:
    """Text from the start of the line that contains position ``pos`` ('' when NULL)."""
    head = F.substring_index(F.substring(s, 1, pos - 1), "\n", -1)
    return F.coalesce(F.substr(s, pos - F.length(head)), F.lit(""))


def statement_start(s: Column) -> Column:
    """Text from the first line holding a statement keyword."""
    return line_start_from(s, keyword_position(s))


def statement_block(start: Column) -> Column:
    """Cut ``start`` after the first ';' line or before the first blank line, stripped."""
    m_semi = F.regexp_extract(start, SEMI_LINE, 1)
    m_blank = F.regexp_extract(start, BLANK_LINE, 1)
    pick = (F.when((m_semi != "") & ((m_blank == "") | (F.length(m_semi) <= F.length(m_blank))), m_semi)
            .when(m_blank != "", m_blank).otherwise(start))
    return strip(pick)


def sql_candidate(text: Column) -> Column:
    """EXT-02 step 1: the split-off SQL, or the whole text when that is empty."""
    t = F.coalesce(text, F.lit(""))
    s = split_output(t)["sql"]
    return F.when(s == "", t).otherwise(s)


def extract_from(s: Column, start: Column) -> Column:
    """EXT-02 step 2: fenced block, else statement block, else ''."""
    fence = F.instr(F.lower(s), "```sql")
    body = F.substr(s, fence + 6)
    close = F.instr(body, "```")
    fenced = strip(F.when(close > 0, F.substring(body, 1, close - 1)).otherwise(body))
    has_kw = F.upper(s).rlike("|".join(STATEMENT_KEYWORDS))
    return F.when(fence > 0, fenced).when(has_kw, statement_block(start)).otherwise(F.lit(""))


def extract_sql(text: Column) -> Column:
    """EXT-02: SQL from a ```sql fence, else the first statement block, else ''."""
    s = sql_candidate(text)
    return extract_from(s, statement_start(s))


def response_after_prompt(text: Column, prompt: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return strip(F.substr(t, F.length(F.coalesce(prompt, F.lit(""))) + 1))


def extract_from_response(resp: Column) -> Column:
    """EXT-03 step 2: lines from the first one that a statement keyword leads, up to a
    blank line or through a line that ends in ';' and has no keyword of its own; else
    the text before <|im_end|>."""
    lines = F.split(resp, "\n")
    led = rf"(?is)^\s*({'|'.join(STATEMENT_KEYWORDS)})"
    # one letter per line: k led by a keyword, b blank, e ends the statement, o any other
    kinds = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(led), "k").when(strip(x) == "", "b")
                                     .when(F.endswith(strip(x), F.lit(";")), "e").otherwise("o")), "")
    before = F.length(F.regexp_extract(kinds, "^([^k]*)k", 1))
    taken = F.length(F.regexp_extract(kinds, "^[^k]*(k[ko]*e?)", 1))
    sql = strip(F.array_join(F.slice(lines, before + 1, taken), "\n"))
    fallback = strip(F.substring_index(resp, "<|im_end|>", 1))
    return F.when(sql == "", fallback).otherwise(sql)


def extract_sql_after_prompt(text: Column, prompt: Column) -> Column:
    """EXT-03: drop the prompt prefix, then :func:`extract_from_response`."""
    return extract_from_response(response_after_prompt(text, prompt))


# ----------------------------------------------------------------- FIX

NAMED_TABLE = r"(?i)\b(FROM|JOIN|INTO|UPDATE)\s+(?!(?:FROM|JOIN|INTO|UPDATE)\b)(\w+)"


def table_pattern(keyword: str, generic: str) -> str:
    return rf"(?i)\b{keyword}\s+{generic}\b"


def fix_table_names(sql: Column) -> dict[str, Column]:
    """FIX-01: generic table names after FROM/JOIN/INTO/UPDATE -> domain names.

    One pass takes the text apart at the named tables, looks each name up and
    puts the text together again; one correction per mapping that fired, listed
    longest generic name first.
    """
    s = F.coalesce(sql, F.lit(""))
    domains = F.create_map(*[F.lit(x) for m in TABLE_MAPPINGS for x in m])
    whole, keywords, names = (F.regexp_extract_all(s, F.lit(NAMED_TABLE), F.lit(k)) for k in (0, 1, 2))
    found = F.transform(names, lambda n: F.lower(n))
    spots = F.arrays_zip(whole.alias("whole"), keywords.alias("keyword"), found.alias("name"))
    renamed = F.transform(spots, lambda x: F.coalesce(
        F.concat(F.upper(x["keyword"]), F.lit(" "), F.try_element_at(domains, x["name"])), x["whole"]))
    around = F.split(s, NAMED_TABLE, -1)
    out = F.array_join(F.zip_with(around, F.concat(renamed, F.array(F.lit(""))), lambda a, r: F.concat(a, r)), "")
    ordered = sorted(TABLE_MAPPINGS, key=lambda m: len(m[0]), reverse=True)
    fired = F.filter(F.array(*[F.lit(g) for g, _ in ordered]), lambda g: F.array_contains(found, g))
    return {"sql": out, "corrections": F.transform(fired, lambda g: F.concat(
        F.lit("Replaced '"), g, F.lit("' with '"), F.element_at(domains, g), F.lit("'")))}


def fix_column_case(sql: Column) -> dict[str, Column]:
    """FIX-02: known columns to schema spelling when that spelling is absent."""
    s = F.coalesce(sql, F.lit(""))
    out = s
    fired = []
    low = F.lower(s)
    for generic, proper in COLUMN_MAPPINGS:
        pat = rf"(?i)\b{generic}\b"
        cond = ~s.contains(proper) & low.contains(generic) & s.rlike(pat)
        # the pattern itself is switched off (NEVER matches) instead of branching
        # on ``out``, which would double the expression tree at every step
        out = F.regexp_replace(out, F.when(cond, F.lit(pat)).otherwise(F.lit(NEVER)), F.lit(proper))
        fired.append(F.when(cond, F.lit(f"Corrected column '{generic}' to '{proper}'")))
    return {"sql": out, "corrections": F.array_compact(F.array(*fired))}


def uses_domain_tables(sql: Column) -> Column:
    """FIX-03: any domain table named (substring of the upper-cased SQL)."""
    u = F.upper(F.coalesce(sql, F.lit("")))
    out = None
    for t in P.DOMAIN_TABLES:
        out = u.contains(t) if out is None else (out | u.contains(t))
    return out


def tables_used(sql: Column) -> Column:
    """FIX-03: domain tables named in the SQL, in the domain-table order."""
    u = F.upper(F.coalesce(sql, F.lit("")))
    return F.array_compact(F.array(*[F.when(u.contains(t), F.lit(t)) for t in P.DOMAIN_TABLES]))


def fix_from_question(sql: Column, query: Column) -> dict[str, Column]:
    """FIX-04: for ``SELECT * FROM x`` with a non-domain x, use the table of the
    first question keyword (applied when the SQL names no domain table)."""
    s = F.coalesce(sql, F.lit(""))
    ql = F.lower(F.coalesce(query, F.lit("")))
    generic = F.regexp_extract(s, r"(?i)SELECT\s+\*\s+FROM\s+(\w+)", 1)
    usable = (generic != "") & ~F.upper(generic).isin(*P.DOMAIN_TABLES)
    table = None
    for kw, t in QUESTION_TABLE_HINTS:
        cond = ql.contains(kw) & ~s.contains(t)
        table = F.when(cond, F.lit(t)) if table is None else table.when(cond, F.lit(t))
    needle = F.concat(F.lit("FROM "), generic)
    pos = F.instr(s, needle)
    replaced = F.when(pos > 0, F.concat(F.substring(s, 1, pos - 1), F.lit("FROM "), table,
                                        F.substr(s, pos + F.length(needle)))).otherwise(s)
    applies = usable & table.isNotNull()
    return {"sql": F.when(applies, replaced).otherwise(s),
            "corrections": F.when(applies, F.array(F.concat(F.lit("Context-based: replaced '"), generic,
                                                            F.lit("' with '"), table, F.lit("'"))))
            .otherwise(F.array().cast("array<string>"))}


def suggest_improvements(sql: Column, query: Column) -> Column:
    """FIX-06: six question-driven suggestions."""
    s = F.coalesce(sql, F.lit(""))
    su = F.upper(s)
    ql = F.lower(F.coalesce(query, F.lit("")))
    return F.array_compact(F.array(
        F.when(~uses_domain_tables(s), "Use domain-specific table names (PAC_MNT_PROJECTS, SRM_COMPANIES, etc.)"),
        F.when(ql.contains("active") & ~s.contains("Status = 'Active'"), "Consider adding Status = 'Active' filter"),
        F.when(ql.contains("budget") & ~s.contains("Budget"), "Include Budget column or filter"),
        F.when(ql.contains("count") & ~su.contains("COUNT"), "Use COUNT() aggregate function"),
        F.when((ql.contains("group") | ql.contains("per")) & ~su.contains("GROUP BY"), "Consider using GROUP BY clause"),
        F.when((ql.contains("join") | ql.contains("with their")) & ~su.contains("JOIN"),
               "Consider using JOIN to combine tables")))


def repair(sql: Column, query: Column) -> dict[str, Column]:
    """FIX-05 in one call (see ``tessera.operators.textops.repair_report`` for the
    layered DataFrame form used on large inputs)."""
    t = fix_table_names(sql)
    c = fix_column_case(t["sql"])
    has_domain = uses_domain_tables(c["sql"])
    q = F.coalesce(query, F.lit(""))
    ctx = fix_from_question(c["sql"], q)
    apply_ctx = ~has_domain & (q != "")
    final = F.when(apply_ctx, ctx["sql"]).otherwise(c["sql"])
    corrections = F.concat(t["corrections"], c["corrections"],
                           F.when(apply_ctx, ctx["corrections"]).otherwise(F.array().cast("array<string>")))
    return report(sql, final, corrections)


def report(original: Column, processed: Column, corrections: Column) -> dict[str, Column]:
    o = F.coalesce(original, F.lit(""))
    was = processed != o
    uses = uses_domain_tables(processed)
    conf = (F.lit(1.0) - F.when(was, F.size(corrections) * 0.1).otherwise(0.0)
            - F.when(uses, 0.0).otherwise(0.5))
    return {"processed_sql": processed, "was_corrected": was, "corrections": corrections,
            "uses_domain_tables": uses, "confidence": F.greatest(F.lit(0.1), conf)}
