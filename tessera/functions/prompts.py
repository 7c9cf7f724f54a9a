"""Prompt rendering (PRM-01..11) as column expressions.

Every prompt is a ``concat`` over the row's columns; text that is the same for
every row (few-shot examples, per-table schema blocks from the fixed catalog)
is rendered once and enters the plan as a literal or a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.catalog import ERP_SCHEMA, FOREIGN_KEYS, PRIMARY_KEYS
from . import linking as L

IM_START, IM_END = "<|im_start|>", "<|im_end|>"

# ---- fixed values: system prompt texts; the labels inside the render functions are fixed too -------------------------------------------
ZERO_SHOT_SYSTEM = (
    "You are an expert SQL analyst for a GL/ERP database system.\n"
    "CRITICAL: You MUST use the EXACT table names from the schema provided.\n\n"
    "Available Tables (USE THESE EXACT NAMES):\n"
    "- PAC_MNT_PROJECTS (for all project-related queries)\n"
    "- SRM_COMPANIES (for all company-related queries)\n"
    "- PROJSTAFF (for staff/resource assignments)\n"
    "- PROJCNTRTS (for contracts)\n"
    "- PAC_MNT_RESOURCES (for resources)\n"
    "- SRM_CONTACTS (for contacts)\n\n"
    "NEVER use generic names like 'projects', 'companies', 'staff', etc.\n"
    "ALWAYS use the full table names as listed above.\n\n"
    "Instructions:\n"
    "1. Identify which of the above tables are needed\n"
    "2. Use ONLY the table names listed above\n"
    "3. Generate syntactically correct SQL\n")
FEW_SHOT_SYSTEM = ("You are an expert SQL analyst specializing in financial ERP systems. "
                   "Generate accurate SQL queries following the examples provided.\n"
                   "Always provide step-by-step reasoning using <think> tags.\n")
REASONING_SYSTEM = (
    "You are an expert SQL analyst. Your task is to:\n"
    "1. First, think through the problem step-by-step\n"
    "2. Explain your reasoning clearly\n"
    "3. Then generate the SQL query\n\n"
    "IMPORTANT: You MUST provide reasoning in <think> tags before the SQL.\n"
    "The reasoning should include:\n"
    "- Understanding of what the query asks for\n"
    "- Identification of relevant tables\n"
    "- Explanation of joins needed\n"
    "- Justification for filters and conditions\n")
SCHEMA_AWARE_SYSTEM = ("You are an SQL expert. Generate queries using the provided schema.\n"
                       "Focus on the relevant tables and their relationships.\n")
CORRECTION_SYSTEM = ("You are an SQL expert. A previous SQL query had errors.\n"
                     "Analyze the error and generate a corrected version.\n")
TRAINING_SYSTEM = ("You are an expert SQL analyst for a GL/ERP database.\n"
                   "ALWAYS use these exact table names:\n"
                   "PAC_MNT_PROJECTS, SRM_COMPANIES, PROJSTAFF, PROJCNTRTS, PAC_MNT_RESOURCES, SRM_CONTACTS\n"
                   "NEVER use generic table names.\n")
FEEDBACK_SYSTEM = "Learn from the feedback to improve SQL generation.\n"
CHATML_SYSTEM = "You are a SQL expert. Generate SQL queries based on natural language questions.\n"
INSTRUCTION_HEADER = ("### Instruction:\nGenerate an SQL query for the following natural language request.\n"
                      "Use the General Ledger schema with tables like PAC_MNT_PROJECTS, SRM_COMPANIES, etc.\n\n"
                      "### Query:\n")
FEW_SHOT_COUNT = 3
SCHEMA_AWARE_EXAMPLES = 2


def _s(x) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def chat(*parts) -> Column:
    """Concatenate literal strings and columns (NULL columns render as '')."""
    return F.concat(*[F.coalesce(_s(p), F.lit("")) for p in parts])


def zero_shot(query: Column, schema: Column, context: Column | None = None) -> Column:
    """PRM-01; a business context, where there is one, ends the system turn."""
    block = "" if context is None else F.when(
        F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\nBusiness Context:\n"), context, F.lit("\n")))
    return chat(f"{IM_START}system\n{ZERO_SHOT_SYSTEM}", block, f"{IM_END}\n{IM_START}user\nSchema Details:\n", schema,
                "\n\nQuery: ", query, f"\n{IM_END}\n{IM_START}assistant\n")


def few_shot_examples(pairs: DataFrame, n: int = FEW_SHOT_COUNT, examples_label: bool = True) -> Column:
    """COR-23 + PRM-02 example block: the first ``n`` pairs (by ``pair_id``),
    rendered once as text and used as a scalar subquery (bounded: ``n`` rows)."""
    first = pairs.orderBy("pair_id").limit(n)
    first = first.withColumn("__i", F.row_number().over(Window.orderBy("pair_id")))  # window over n rows only
    label = F.concat(F.lit("Example "), F.col("__i").cast("string"), F.lit(":\n")) if examples_label else F.lit("")
    block = chat(f"{IM_START}user\n", label, "Query: ", F.col("query"), f"\n{IM_END}\n{IM_START}assistant\n",
                 F.when(F.coalesce(F.col("reasoning"), F.lit("")) != "",
                        F.concat(F.lit("<think>\n"), F.col("reasoning"), F.lit("\n</think>\n\n"))),
                 F.col("sql"), f"\n{IM_END}\n")
    agg = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__i"), block.alias("b")))),
                                             lambda s: s["b"]), "").alias("t"))
    return agg.select(F.coalesce("t", F.lit(""))).scalar()


def few_shot(query: Column, schema: Column, examples_text: Column) -> Column:
    """PRM-02."""
    return chat(f"{IM_START}system\n{FEW_SHOT_SYSTEM}{IM_END}\n", examples_text,
                f"{IM_START}user\nNow generate SQL for this query:\nSchema:\n", schema, "\n\nQuery: ", query,
                f"\n{IM_END}\n{IM_START}assistant\n")


def reasoning_first(query: Column, schema: Column) -> Column:
    """PRM-03: ends in an open ``<think>``."""
    return chat(f"{IM_START}system\n{REASONING_SYSTEM}{IM_END}\n{IM_START}user\nSchema:\n", schema, "\n\nQuery: ",
                query, f"\n{IM_END}\n{IM_START}assistant\n<think>\n")


def _fk_map() -> dict[str, list[tuple[str, str]]]:
    out: dict[str, list[tuple[str, str]]] = {}
    for t, c, rt, rc in FOREIGN_KEYS:
        out.setdefault(t, []).append((c, f"{rt}.{rc}"))
    return out


def schema_aware_block(table: str) -> str:
    """One table's section for PRM-04 (from the fixed catalog)."""
    desc = {n: d for n, d, _ in L.TABLE_DEFINITIONS}
    text = f"\nTable: {table}\n"
    if table in desc:
        text += f"Description: {desc[table]}\n"
    text += "Columns:\n"
    for c, ty in ERP_SCHEMA[table]:
        text += f"  - {c} ({ty})" + (" NOT NULL" if PRIMARY_KEYS.get(table) == c else "") + "\n"
    text += f"Primary Keys: {PRIMARY_KEYS[table]}\n"
    fks = _fk_map().get(table)
    if fks:
        text += "Foreign Keys:\n" + "".join(f"  - {c} -> {ref}\n" for c, ref in fks)
    return text


def format_schema_block(table: str, max_columns: int | None = None, descriptions: bool = True,
                        relationships: bool = True) -> str:
    """PRM-09: ``Table: x -- desc``, columns (all unless ``max_columns``), PK and FK lines."""
    desc = {n: d for n, d, _ in L.TABLE_DEFINITIONS} if descriptions else {}
    text = f"Table: {table}" + (f" -- {desc[table]}" if table in desc else "") + "\n"
    for c, ty in ERP_SCHEMA[table][:max_columns]:
        text += f"  {c} {ty}" + (" NOT NULL" if PRIMARY_KEYS.get(table) == c else "") + "\n"
    text += f"  PRIMARY KEY: {PRIMARY_KEYS[table]}\n"
    for c, ref in _fk_map().get(table, []) if relationships else []:
        text += f"  FOREIGN KEY: {c} -> {ref}\n"
    return text + "\n"


def _blocks(tables: Column, render) -> Column:
    m = F.create_map(*[x for t in ERP_SCHEMA for x in (F.lit(t), F.lit(render(t)))])
    return F.array_join(F.transform(tables, lambda t: F.coalesce(F.try_element_at(m, t), F.lit(""))), "")


def schema_aware(query: Column, tables: Column, related: Column, examples_text: Column) -> Column:
    """PRM-04: detailed table sections, relationships and up to two examples."""
    rel = F.when(F.size(related) > 0, F.concat(F.lit("\nTable Relationships:\n"), F.array_join(
        F.transform(related, lambda r: F.concat(F.lit("  - "), F.regexp_replace(r, ": ", " relates to: "),
                                                F.lit("\n"))), "")))
    return chat(f"{IM_START}system\n{SCHEMA_AWARE_SYSTEM}{IM_END}\n", examples_text, f"{IM_START}user\nRelevant Tables:\n",
                _blocks(tables, schema_aware_block), rel, "\nQuery: ", query, f"\n{IM_END}\n{IM_START}assistant\n")


def correction(query: Column, bad_sql: Column, error: Column, schema: Column) -> Column:
    """PRM-05."""
    return chat(f"{IM_START}system\n{CORRECTION_SYSTEM}{IM_END}\n{IM_START}user\nOriginal Query: ", query,
                "\n\nIncorrect SQL:\n", bad_sql, "\n\nError: ", error, "\n\nSchema:\n", schema,
                f"\n\nPlease provide the corrected SQL with reasoning.\n{IM_END}\n{IM_START}assistant\n<think>\n"
                "The error '", error, "' suggests that ")


def training(query: Column, schema: Column, sql: Column, reasoning: Column) -> Column:
    """PRM-06: expected SQL as the assistant turn; reasoning in <think> when present."""
    think = F.when(F.coalesce(reasoning, F.lit("")) != "",
                   F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n")))
    return chat(f"{IM_START}system\n{TRAINING_SYSTEM}{IM_END}\n{IM_START}user\nSchema:\n", schema, "\n\nQuery: ", query,
                f"\n{IM_END}\n{IM_START}assistant\n", think, sql, f"\n{IM_END}")


def feedback(query: Column, sql: Column, fb: Column, correct_sql: Column) -> Column:
    """PRM-07: optional corrected SQL."""
    corr = F.when(F.coalesce(correct_sql, F.lit("")) != "", F.concat(F.lit("\nCorrect SQL:\n"), correct_sql, F.lit("\n")))
    return chat(f"{IM_START}system\n{FEEDBACK_SYSTEM}{IM_END}\n{IM_START}user\nQuery: ", query, "\n\nGenerated SQL:\n",
                sql, "\n\nFeedback: ", fb, "\n", corr, f"\nExplain what was wrong and how to fix it.\n{IM_END}\n"
                f"{IM_START}assistant\n")


def chatml_conversation(query: Column, sql: Column, context: Column) -> Column:
    """PRM-08a: full conversation with a context line."""
    return chat(f"{IM_START}system\n{CHATML_SYSTEM}Context: ", context, f"{IM_END}\n{IM_START}user\n", query,
                f"{IM_END}\n{IM_START}assistant\n", sql, IM_END)


def prompt_response(query: Column, sql: Column, schema: Column) -> dict[str, Column]:
    """PRM-08b: prompt / response split."""
    return {"prompt": chat(f"{IM_START}system\n{CHATML_SYSTEM}Schema: ", schema, f"{IM_END}\n{IM_START}user\n", query,
                           f"{IM_END}\n{IM_START}assistant"),
            "response": chat(sql, IM_END)}


def instruction_format(query: Column, sql: Column, reasoning: Column) -> dict[str, Column]:
    """PRM-08c: ``### Instruction`` prompt and response (reasoning appended when present)."""
    resp = F.when(F.coalesce(reasoning, F.lit("")) != "",
                  F.concat(sql, F.lit("\n\n### Reasoning:\n"), reasoning)).otherwise(sql)
    return {"prompt": chat(INSTRUCTION_HEADER, query, "\n\n### SQL:"), "response": resp}


def format_schema_context(tables: Column, max_columns: int | None = None, descriptions: bool = True,
                          relationships: bool = True) -> Column:
    """PRM-09: schema text for ``tables`` (stripped)."""
    from .textfix import strip
    return strip(_blocks(tables, lambda t: format_schema_block(t, max_columns, descriptions, relationships)))


def parse_steps(reasoning: Column, max_steps: int | None = None) -> Column:
    """PRM-11: ``Step n:`` pieces, else sentences split on '.'; all unless ``max_steps``."""
    r = F.coalesce(reasoning, F.lit(""))
    from .textfix import strip
    pieces = F.split(r, r"Step \d+: ")
    structured = F.transform(F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.length(p) > 0), lambda p: strip(p))
    sentences = F.filter(F.transform(F.split(r, r"\."), lambda p: strip(p)), lambda p: p != "")
    steps = F.when(r.contains("Step") & (F.size(structured) > 0), structured).otherwise(sentences)
    shown = steps if max_steps is None else F.slice(steps, 1, max_steps)
    return F.when(r == "", F.array(F.lit("No reasoning provided"))).otherwise(shown)


def format_steps(steps: Column) -> Column:
    """PRM-10: ``<think>\\nStep i: ...\\n</think>``."""
    lines = F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s, F.lit("\n")))
    return F.concat(F.lit("<think>\n"), F.array_join(lines, ""), F.lit("</think>"))
