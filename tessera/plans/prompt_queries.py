"""PRM-01..11 over the pair / candidate tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import linking as L
from ..functions import prompts as PR
from ..functions import textfix as TF
from ..operators import scoring as S
from ..sources.catalog import ERP_SCHEMA
from ..storage import written
from . import textfix_sql as XT
from .linking_queries import x_entity_tables, x_related, x_schema_context
from .registry import query
from .scoring_queries import DISTINCT_SQL, SCORED
from .sqltext_sql import q

IM_S, IM_E = PR.IM_START, PR.IM_END


def chat(*parts: str) -> str:
    """SQL twin of ``prompts.chat``: literals are Python str wrapped by ``lit``."""
    return "concat(" + ", ".join(f"coalesce({p}, '')" for p in parts) + ")"


def lit(s: str) -> str:
    return q(s)


def x_examples(n: int, label: bool = True) -> str:
    lab = "'Example ' || CAST(i AS VARCHAR) || ':' || chr(10)" if label else "''"
    block = chat(lit(f"{IM_S}user\n"), lab, lit("Query: "), "query", lit(f"\n{IM_E}\n{IM_S}assistant\n"),
                 "CASE WHEN coalesce(reasoning, '') <> '' THEN '<think>' || chr(10) || reasoning || chr(10) || "
                 "'</think>' || chr(10) || chr(10) END", "sql", lit(f"\n{IM_E}\n"))
    return (f"(SELECT coalesce(string_agg({block}, '' ORDER BY i), '') FROM (SELECT *, row_number() OVER "
            f"(ORDER BY pair_id) AS i FROM (SELECT * FROM pairs ORDER BY pair_id LIMIT {n})))")


def x_blocks(tables: str, render) -> str:
    m = "MAP {" + ", ".join(f"{q(t)}: {q(render(t))}" for t in ERP_SCHEMA) + "}"
    return f"array_to_string(list_transform({tables}, lambda t: coalesce({m}[t], '')), '')"


def x_parse_steps(r: str) -> str:
    rr = f"coalesce({r}, '')"
    pieces = f"string_split_regex({rr}, 'Step \\d+: ')"
    structured = f"list_transform(list_filter({pieces}[2:], lambda p: length(p) > 0), lambda p: {XT.strip('p')})"
    sentences = f"list_filter(list_transform(string_split({rr}, '.'), lambda p: {XT.strip('p')}), lambda p: p <> '')"
    steps = f"(CASE WHEN contains({rr}, 'Step') AND len({structured}) > 0 THEN {structured} ELSE {sentences} END)"
    return f"(CASE WHEN {rr} = '' THEN ['No reasoning provided'] ELSE {steps} END)"


def x_format_steps(steps: str) -> str:
    lines = f"list_transform({steps}, lambda s, i: 'Step ' || CAST(i AS VARCHAR) || ': ' || s || chr(10))"
    return f"('<think>' || chr(10) || array_to_string({lines}, '') || '</think>')"


_SCH = x_schema_context("query")


_CTX = "CASE WHEN domain <> 'resources' THEN 'Business Context:' || chr(10) || domain || chr(10) END"


@query("prm_01", f"SELECT pair_id, {chat(lit(f'{IM_S}system' + chr(10) + PR.ZERO_SHOT_SYSTEM), 'chr(10) || ' + _CTX, lit(IM_E + chr(10) + IM_S + 'user' + chr(10) + 'Schema Details:' + chr(10)), _SCH, lit(chr(10) * 2 + 'Query: '), 'query', lit(chr(10) + IM_E + chr(10) + IM_S + 'assistant' + chr(10)))} AS prompt FROM pairs")
def prm_01(v):
    """PRM-01; the pair's domain is the business context, and one domain has none."""
    context = F.when(F.col("domain") != "resources", F.col("domain"))
    return v.pairs.select("pair_id", PR.zero_shot(F.col("query"), L.schema_context(F.col("query")), context).alias("prompt"))


@query("prm_02", f"SELECT pair_id, {chat(lit(f'{IM_S}system' + chr(10) + PR.FEW_SHOT_SYSTEM + IM_E + chr(10)), x_examples(PR.FEW_SHOT_COUNT), lit(IM_S + 'user' + chr(10) + 'Now generate SQL for this query:' + chr(10) + 'Schema:' + chr(10)), _SCH, lit(chr(10) * 2 + 'Query: '), 'query', lit(chr(10) + IM_E + chr(10) + IM_S + 'assistant' + chr(10)))} AS prompt FROM pairs")
def prm_02(v):
    ex = PR.few_shot_examples(v.pairs)
    return v.pairs.select("pair_id", PR.few_shot(F.col("query"), L.schema_context(F.col("query")), ex).alias("prompt"))


@query("prm_03", f"SELECT pair_id, {chat(lit(f'{IM_S}system' + chr(10) + PR.REASONING_SYSTEM + IM_E + chr(10) + IM_S + 'user' + chr(10) + 'Schema:' + chr(10)), _SCH, lit(chr(10) * 2 + 'Query: '), 'query', lit(chr(10) + IM_E + chr(10) + IM_S + 'assistant' + chr(10) + '<think>' + chr(10)))} AS prompt FROM pairs")
def prm_03(v):
    return v.pairs.select("pair_id", PR.reasoning_first(F.col("query"), L.schema_context(F.col("query"))).alias("prompt"))


_REL = ("CASE WHEN len(related) > 0 THEN chr(10) || 'Table Relationships:' || chr(10) || array_to_string("
        "list_transform(related, lambda r: '  - ' || replace(r, ': ', ' relates to: ') || chr(10)), '') END")


@query("prm_04", f"""WITH t AS (SELECT pair_id, query, {x_entity_tables('query')} AS tables FROM pairs),
r AS (SELECT *, {x_related('tables')} AS related FROM t)
SELECT pair_id, {chat(lit(f'{IM_S}system' + chr(10) + PR.SCHEMA_AWARE_SYSTEM + IM_E + chr(10)),
                      x_examples(PR.SCHEMA_AWARE_EXAMPLES, label=False), lit(IM_S + 'user' + chr(10) + 'Relevant Tables:' + chr(10)),
                      x_blocks('tables', PR.schema_aware_block), _REL, lit(chr(10) + 'Query: '), 'query',
                      lit(chr(10) + IM_E + chr(10) + IM_S + 'assistant' + chr(10)))} AS prompt FROM r""")
def prm_04(v):
    ex = PR.few_shot_examples(v.pairs, PR.SCHEMA_AWARE_EXAMPLES, examples_label=False)
    t = v.pairs.select("pair_id", "query", L.entities_to_tables(F.col("query")).alias("tables"))
    t = t.select("*", L.related_tables(F.col("tables")).alias("related"))
    return t.select("pair_id", PR.schema_aware(F.col("query"), F.col("tables"), F.col("related"), ex).alias("prompt"))


_ERR = ("array_to_string(syntax_errors || schema_errors || business_errors || security_warnings, '; ')")


@query("prm_05", f"""WITH {DISTINCT_SQL},
d AS (SELECT DISTINCT query, sql FROM candidates),
e AS (SELECT d.query, d.sql, {_ERR} AS error FROM d JOIN sv ON d.sql = sv.sql WHERE NOT sv.is_valid_strict)
SELECT query, sql, error, {chat(lit(f'{IM_S}system' + chr(10) + PR.CORRECTION_SYSTEM + IM_E + chr(10) + IM_S + 'user' + chr(10) + 'Original Query: '), 'query', lit(chr(10) * 2 + 'Incorrect SQL:' + chr(10)), 'sql', lit(chr(10) * 2 + 'Error: '), 'error', lit(chr(10) * 2 + 'Schema:' + chr(10)), _SCH, lit(chr(10) * 2 + 'Please provide the corrected SQL with reasoning.' + chr(10) + IM_E + chr(10) + IM_S + 'assistant' + chr(10) + '<think>' + chr(10) + "The error '"), 'error', lit("' suggests that "))} AS prompt FROM e""")
def prm_05(v):
    """PRM-05: each SQL text is validated once and each question's context made once, on all cores.

    Errors and contexts are written before they are joined: a filter on the validation's outcome would
    otherwise be moved below it, and take the whole validation with it.
    """
    d = v.candidates.select("query", "sql").distinct()
    val = S.validate(S.spread(v.candidates.select("sql").distinct(), "sql"))
    errors = F.array_join(F.concat("syntax_errors", "schema_errors", "business_errors", "security_warnings"), "; ")
    wrong = written(val.select("sql", errors.alias("error"), "is_valid_strict"), "errors").where(~F.col("is_valid_strict"))
    asked = S.spread(v.pairs.select("query").distinct(), "query")
    asked = written(asked.select("query", L.schema_context(F.col("query")).alias("context")), "contexts")
    e = d.join(wrong.select("sql", "error"), "sql")
    # a null question has its context, too
    e = e.join(asked.withColumnRenamed("query", "__query"), F.col("query").eqNullSafe(F.col("__query")))
    return e.select("query", "sql", "error",
                    PR.correction(F.col("query"), F.col("sql"), F.col("error"), F.col("context")).alias("prompt"))


@query("prm_06", f"""SELECT pair_id, {chat(lit(f'{IM_S}system' + chr(10) + PR.TRAINING_SYSTEM + IM_E + chr(10) + IM_S + 'user' + chr(10) + 'Schema:' + chr(10)), _SCH, lit(chr(10) * 2 + 'Query: '), 'query', lit(chr(10) + IM_E + chr(10) + IM_S + 'assistant' + chr(10)), "CASE WHEN coalesce(reasoning, '') <> '' THEN '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || chr(10) END", 'sql', lit(chr(10) + IM_E))} AS prompt FROM pairs""")
def prm_06(v):
    p = v.pairs
    return p.select("pair_id", PR.training(F.col("query"), L.schema_context(F.col("query")), F.col("sql"),
                                          F.col("reasoning")).alias("prompt"))


_FB = ("array_to_string(CASE WHEN len(list_filter([CASE WHEN syntax_reward < 0 THEN 'Improve SQL syntax correctness' END, "
       "CASE WHEN schema_reward < 0 THEN 'Ensure tables and columns exist in schema' END, CASE WHEN business_reward < 0 "
       "THEN 'Follow business rules and constraints' END, CASE WHEN performance_reward < 0 THEN 'Optimize query for "
       "better performance' END, CASE WHEN reasoning_reward < 0 THEN 'Provide clearer step-by-step reasoning' END, "
       "CASE WHEN coalesce(accuracy_reward, 0.0) < 0 THEN 'Generated SQL differs significantly from expected' END], "
       "lambda x: x IS NOT NULL)) = 0 THEN ['Good SQL generation with proper reasoning'] ELSE list_filter([CASE WHEN "
       "syntax_reward < 0 THEN 'Improve SQL syntax correctness' END, CASE WHEN schema_reward < 0 THEN 'Ensure tables "
       "and columns exist in schema' END, CASE WHEN business_reward < 0 THEN 'Follow business rules and constraints' "
       "END, CASE WHEN performance_reward < 0 THEN 'Optimize query for better performance' END, CASE WHEN "
       "reasoning_reward < 0 THEN 'Provide clearer step-by-step reasoning' END, CASE WHEN coalesce(accuracy_reward, "
       "0.0) < 0 THEN 'Generated SQL differs significantly from expected' END], lambda x: x IS NOT NULL) END, '; ')")


@query("prm_07", f"""WITH {SCORED},
f AS (SELECT prompt_id, cand_id, query, sql, expected_sql, total_reward, {_FB} AS fb FROM scored)
SELECT prompt_id, cand_id, sql, {chat(lit(f'{IM_S}system' + chr(10) + PR.FEEDBACK_SYSTEM + IM_E + chr(10) + IM_S + 'user' + chr(10) + 'Query: '), 'query', lit(chr(10) * 2 + 'Generated SQL:' + chr(10)), 'sql', lit(chr(10) * 2 + 'Feedback: '), 'fb', lit(chr(10)), "CASE WHEN total_reward <= 0 AND coalesce(expected_sql, '') <> '' THEN chr(10) || 'Correct SQL:' || chr(10) || expected_sql || chr(10) END", lit(chr(10) + 'Explain what was wrong and how to fix it.' + chr(10) + IM_E + chr(10) + IM_S + 'assistant' + chr(10)))} AS prompt FROM f""")
def prm_07(v):
    from ..functions import sqltext as T
    s = S.score(v.candidates)
    fb = F.array_join(T.reward_feedback({k: F.col(k) for k in S.COMPONENTS}), "; ")
    correct = F.when(F.col("total_reward") <= 0, F.col("expected_sql"))
    return s.select("prompt_id", "cand_id", "sql",
                    PR.feedback(F.col("query"), F.col("sql"), fb, correct).alias("prompt"))


@query("prm_08", f"""SELECT pair_id,
{chat(lit(f'{IM_S}system' + chr(10) + PR.CHATML_SYSTEM + 'Context: '), 'reasoning', lit(IM_E + chr(10) + IM_S + 'user' + chr(10)), 'query', lit(IM_E + chr(10) + IM_S + 'assistant' + chr(10)), 'sql', lit(IM_E))} AS conversation,
{chat(lit(f'{IM_S}system' + chr(10) + PR.CHATML_SYSTEM + 'Schema: '), _SCH, lit(IM_E + chr(10) + IM_S + 'user' + chr(10)), 'query', lit(IM_E + chr(10) + IM_S + 'assistant'))} AS prompt,
{chat('sql', lit(IM_E))} AS response,
{chat(lit(PR.INSTRUCTION_HEADER), 'query', lit(chr(10) * 2 + '### SQL:'))} AS instruction,
CASE WHEN coalesce(reasoning, '') <> '' THEN sql || chr(10) || chr(10) || '### Reasoning:' || chr(10) || reasoning ELSE sql END AS instruction_response
FROM pairs""")
def prm_08(v):
    p = v.pairs
    pr = PR.prompt_response(F.col("query"), F.col("sql"), L.schema_context(F.col("query")))
    ins = PR.instruction_format(F.col("query"), F.col("sql"), F.col("reasoning"))
    return p.select("pair_id", PR.chatml_conversation(F.col("query"), F.col("sql"), F.col("reasoning")).alias("conversation"),
                    pr["prompt"].alias("prompt"), pr["response"].alias("response"),
                    ins["prompt"].alias("instruction"), ins["response"].alias("instruction_response"))


@query("prm_09", f"""WITH d AS (SELECT DISTINCT query FROM pairs), t AS (SELECT query, {x_entity_tables('query')} AS tables FROM d)
SELECT query, {XT.strip(x_blocks('tables', PR.format_schema_block))} AS schema_text FROM t""")
def prm_09(v):
    t = v.pairs.select("query").distinct().select("query", L.entities_to_tables(F.col("query")).alias("tables"))
    return t.select("query", PR.format_schema_context(F.col("tables")).alias("schema_text"))


@query("prm_09_brief", f"""WITH d AS (SELECT DISTINCT query FROM pairs), t AS (SELECT query, {x_entity_tables('query')} AS tables FROM d)
SELECT query, {XT.strip(x_blocks('tables', lambda t: PR.format_schema_block(t, 3, False, False)))} AS schema_text FROM t""")
def prm_09_brief(v):
    """PRM-09 without descriptions and relationships, three columns a table."""
    t = v.pairs.select("query").distinct().select("query", L.entities_to_tables(F.col("query")).alias("tables"))
    return t.select("query", PR.format_schema_context(F.col("tables"), 3, False, False).alias("schema_text"))


@query("prm_10", f"""WITH d AS (SELECT DISTINCT reasoning FROM pairs)
SELECT reasoning, {x_format_steps(x_parse_steps('reasoning'))} AS think_block FROM d""")
def prm_10(v):
    d = v.pairs.select("reasoning").distinct()
    return d.select("reasoning", PR.format_steps(PR.parse_steps(F.col("reasoning"))).alias("think_block"))


@query("prm_11", f"""WITH d AS (SELECT DISTINCT reasoning FROM pairs)
SELECT reasoning, array_to_string({x_parse_steps('reasoning')}, ' | ') AS steps FROM d""")
def prm_11(v):
    d = v.pairs.select("reasoning").distinct()
    return d.select("reasoning", F.array_join(PR.parse_steps(F.col("reasoning")), " | ").alias("steps"))
