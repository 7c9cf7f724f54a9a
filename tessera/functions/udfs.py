"""UDF surface (UDF-01, UDF-03).

* UDF-01: SQL-callable functions. Each body is the SQL text of the same native
  Column expression the DataFrame API uses (so both stay in sync), registered as
  a SQL-bodied temporary function — Spark inlines it into the plan, no Python.
  Only lambda-free expressions are exposed (lambda variables do not round-trip
  through SQL text). The SQL text comes from the classic session's plan, so these
  functions are registered on a classic session, not over Spark Connect.
* UDF-03: a custom reward hook: any ``DataFrame -> DataFrame`` function that adds
  a column, folded into the total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as T
from . import textfix as TF

PREFIX = "tessera_"
STRUCTURE = ("STRUCT<query_type: STRING, tables: ARRAY<STRING>, has_where: BOOLEAN, has_join: BOOLEAN, has_group_by: BOOLEAN, "
             "has_order_by: BOOLEAN, has_limit: BOOLEAN>")

#: Items of a list as in :mod:`sqltext`; a plan's text has no lambdas, so these are written out.
LIST_ITEMS = """filter(transform(aggregate(split(s, ','),
  named_struct('done', CAST(array() AS ARRAY<STRING>), 'open', CAST(NULL AS STRING), 'depth', 0),
  (a, p) -> named_struct(
    'done', if(a.depth + length(replace(p, ')', '')) - length(replace(p, '(', '')) <= 0,
               array_append(a.done, coalesce(concat(a.open, ',', p), p)), a.done),
    'open', if(a.depth + length(replace(p, ')', '')) - length(replace(p, '(', '')) <= 0,
               CAST(NULL AS STRING), coalesce(concat(a.open, ',', p), p)),
    'depth', a.depth + length(replace(p, ')', '')) - length(replace(p, '(', ''))),
  a -> if(a.open IS NULL, a.done, array_append(a.done, a.open))), x -> trim(x)), x -> x <> '')"""


def _body(spark: SparkSession, col: Column, *params: str) -> str:
    """SQL text of a Column expression over STRING parameters (``s`` unless named), from the analyzed plan."""
    df = spark.createDataFrame([], ", ".join(f"{p} string" for p in params or ("s",))).select(col.alias("o"))
    return df._jdf.queryExecution().analyzed().projectList().head().child().sql()


def sql_function_bodies(spark: SparkSession) -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, SQL body).

    Extraction is a chain of small functions: a parameter is evaluated once, where
    one nested expression would repeat its inner steps at every use.
    """
    s, start, text = F.col("s"), F.col("start"), F.col("text")

    def one(rtype: str, col: Column) -> tuple[str, str, str]:
        return "s STRING", rtype, _body(spark, col)

    def call(name: str, *args: str) -> str:
        return f"{PREFIX}{name}({', '.join(args)})"

    return {
        "normalize_sql": one("STRING", T.normalize_sql(s)),
        "normalize_sql_eval": one("STRING", T.normalize_sql_eval(s)),
        "uses_domain_tables": one("BOOLEAN", TF.uses_domain_tables(s)),
        "query_type": one("STRING", T.query_type(F.upper(s))),
        "masked_upper": one("STRING", T.masked_upper(s)),
        "group_list": one("STRING", T.group_list(s)),
        "list_items": ("s STRING", "ARRAY<STRING>", LIST_ITEMS),
        "complexity_of": ("s STRING, n INT", "DOUBLE", _body(spark, T.complexity_score(s, F.col("n").cast("int")), "s", "n")),
        "complexity_score": ("s STRING", "DOUBLE", call("complexity_of", call("masked_upper", "s"), "size("
                             + call("list_items", call("group_list", call("masked_upper", "s"))) + ")")),
        "sql_structure": one(STRUCTURE, F.struct(*[c.alias(k) for k, c in T.sql_structure(s).items()])),
        "after_think": one("STRING", TF.think_parts(s)["after"]),
        "clean_output": one("STRING", TF.clean_sql(s)),
        "drop_prefix": one("STRING", TF.drop_sql_prefix(s)),
        "line_from": ("s STRING, pos INT", "STRING", _body(spark, TF.line_start_from(s, F.col("pos").cast("int")), "s", "pos")),
        "statement_start": ("s STRING", "STRING", call("line_from", "s", _body(spark, TF.keyword_position(s)))),
        "cut_statement": ("s STRING, start STRING", "STRING", _body(spark, TF.extract_from(s, start), "s", "start")),
        "statement_of": ("s STRING", "STRING", call("cut_statement", "s", call("statement_start", "s"))),
        "or_text": ("s STRING, text STRING", "STRING",
                    _body(spark, F.when(s == "", F.coalesce(text, F.lit(""))).otherwise(s), "s", "text")),
        "extract_sql": ("s STRING", "STRING", call("statement_of", call(
            "or_text", call("drop_prefix", call("clean_output", call("after_think", "s"))), "s"))),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """UDF-01: create the ``tessera_<name>`` temporary SQL functions."""
    names = []
    for name, (params, rtype, body) in sql_function_bodies(spark).items():
        fname = PREFIX + name
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {fname}({params}) RETURNS {rtype} RETURN {body}")
        names.append(fname)
    return names


def score_with(scored: DataFrame, hook, weight: float = 1.0, column: str = "custom_reward") -> DataFrame:
    """UDF-03: apply ``hook`` (DataFrame -> DataFrame adding ``column``) and add it to the total."""
    out = hook(scored)
    return out.withColumn("total_reward", F.col("total_reward") + F.coalesce(F.col(column), F.lit(0.0)) * weight)
