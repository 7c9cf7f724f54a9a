"""EXT-01..03 and FIX-01..06 over the generations / candidate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import textfix as TF
from ..operators import textops as O
from ..operators.scoring import spread
from . import textfix_sql as X
from .registry import query


def _arr(name: str) -> str:
    return f"array_to_string({name}, ' | ') AS {name}"


@query("ext_01", f"""SELECT prompt_id, cand_id, {X.split_output('text')['sql']} AS out_sql,
{X.split_output('text')['reasoning']} AS out_reasoning FROM generations""")
def ext_01(v):
    return O.split_outputs(v.generations).select("prompt_id", "cand_id", "out_sql", "out_reasoning")


@query("ext_02", f"""WITH a AS (SELECT prompt_id, cand_id, model, {X.sql_candidate('text')} AS s FROM generations),
b AS (SELECT *, {X.statement_start('s')} AS st FROM a)
SELECT prompt_id, cand_id, model, {X.extract_from('s', 'st')} AS extracted_sql FROM b""")
def ext_02(v):
    return O.extract_sql(v.generations).select("prompt_id", "cand_id", "model", "extracted_sql")


@query("ext_03", f"""WITH p AS (SELECT prompt_id, cand_id, 'Question ' || CAST(prompt_id AS VARCHAR) || ': ' AS prompt, text FROM generations),
a AS (SELECT prompt_id, cand_id, {X.response_after_prompt('prompt || text', 'prompt')} AS resp FROM p),
b AS (SELECT *, {X.line_kinds('resp')} AS kinds FROM a)
SELECT prompt_id, cand_id, {X.extract_from_response('resp', 'kinds')} AS extracted_sql FROM b""")
def ext_03(v):
    """EXT-03 on outputs that repeat their prompt."""
    prompt = F.concat(F.lit("Question "), F.col("prompt_id").cast("string"), F.lit(": "))
    g = v.generations.withColumn("prompt", prompt).withColumn("text", F.concat("prompt", "text"))
    return O.extract_after_prompt(g, "text", "prompt").select("prompt_id", "cand_id", "extracted_sql")


_T = X.fix_table_names("sql")


@query("fix_01", f"""WITH d AS (SELECT DISTINCT sql FROM candidates)
SELECT sql, {_T['sql']} AS fixed_sql, array_to_string({_T['corrections']}, ' | ') AS corrections FROM d""")
def fix_01(v):
    d = spread(v.candidates.select("sql").distinct(), "sql")
    t = TF.fix_table_names(F.col("sql"))
    return d.select("sql", t["sql"].alias("fixed_sql"), F.array_join(t["corrections"], " | ").alias("corrections"))


_C = X.fix_column_case("sql")


@query("fix_02", f"""WITH d AS (SELECT DISTINCT sql FROM candidates)
SELECT sql, {_C['sql']} AS fixed_sql, array_to_string({_C['corrections']}, ' | ') AS corrections FROM d""")
def fix_02(v):
    d = spread(v.candidates.select("sql").distinct(), "sql")
    c = TF.fix_column_case(F.col("sql"))
    return d.select("sql", c["sql"].alias("fixed_sql"), F.array_join(c["corrections"], " | ").alias("corrections"))


@query("fix_03", f"""WITH d AS (SELECT DISTINCT sql FROM candidates)
SELECT sql, {X.uses_domain_tables('sql')} AS uses_domain_tables,
array_to_string({X.tables_used('sql')}, ' | ') AS tables_used FROM d""")
def fix_03(v):
    d = spread(v.candidates.select("sql").distinct(), "sql")
    return d.select("sql", TF.uses_domain_tables(F.col("sql")).alias("uses_domain_tables"),
                    F.array_join(TF.tables_used(F.col("sql")), " | ").alias("tables_used"))


_Q = X.fix_from_question("sql", "query")


@query("fix_04", f"""WITH d AS (SELECT DISTINCT sql, query FROM candidates)
SELECT sql, query, {_Q['sql']} AS fixed_sql, array_to_string({_Q['corrections']}, ' | ') AS corrections FROM d""")
def fix_04(v):
    d = spread(v.candidates.select("sql", "query").distinct(), "sql")
    r = TF.fix_from_question(F.col("sql"), F.col("query"))
    return d.select("sql", "query", r["sql"].alias("fixed_sql"),
                    F.array_join(r["corrections"], " | ").alias("corrections"))


_T1 = X.fix_table_names("sql")
_C2 = X.fix_column_case("s1")
_Q3 = X.fix_from_question("s2", "coalesce(query, '')")
_APPLY = f"(NOT {X.uses_domain_tables('s2')} AND coalesce(query, '') <> '')"
_R = X.report("sql", "s3", "corr")


@query("fix_05", f"""WITH d AS (SELECT DISTINCT sql, query FROM candidates),
l1 AS (SELECT *, {_T1['sql']} AS s1, {_T1['corrections']} AS c1 FROM d),
l2 AS (SELECT *, {_C2['sql']} AS s2, {_C2['corrections']} AS c2 FROM l1),
l3 AS (SELECT *, CASE WHEN {_APPLY} THEN {_Q3['sql']} ELSE s2 END AS s3,
  CASE WHEN {_APPLY} THEN {_Q3['corrections']} ELSE []::VARCHAR[] END AS c3 FROM l2),
l4 AS (SELECT *, c1 || c2 || c3 AS corr FROM l3)
SELECT sql, query, {_R['processed_sql']} AS processed_sql, {_R['was_corrected']} AS was_corrected,
array_to_string({_R['corrections']}, ' | ') AS corrections, {_R['uses_domain_tables']} AS uses_domain_tables,
floor({_R['confidence']} * 1000000 + 0.5) / 1000000 AS confidence FROM l4""")
def fix_05(v):
    d = O.repair_report(spread(v.candidates.select("sql", "query").distinct(), "sql"))
    return d.select("sql", "query", "processed_sql", "was_corrected",
                    F.array_join("corrections", " | ").alias("corrections"), "uses_domain_tables",
                    (F.floor(F.col("confidence") * 1000000 + 0.5) / 1000000).alias("confidence"))


@query("fix_06", f"""WITH d AS (SELECT DISTINCT sql, query FROM candidates)
SELECT sql, query, array_to_string({X.suggest_improvements('sql', 'query')}, ' | ') AS suggestions FROM d""")
def fix_06(v):
    d = spread(v.candidates.select("sql", "query").distinct(), "sql")
    return d.select("sql", "query",
                    F.array_join(TF.suggest_improvements(F.col("sql"), F.col("query")), " | ").alias("suggestions"))
