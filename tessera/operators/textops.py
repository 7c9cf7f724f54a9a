"""DataFrame forms of extraction and repair (EXT-*, FIX-*), projected in layers.

Each intermediate value (split-off SQL, statement start, table-fixed SQL, ...)
is its own projection so it is computed once per row; Catalyst keeps the layers
separate because they hold non-trivial expressions referenced more than once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textfix as TF
from .scoring import spread


def _split_layers(df: DataFrame, text: str) -> DataFrame:
    """EXT-01 in three projections: think parts -> cleaned text -> final SQL."""
    p = TF.think_parts(F.col(text))
    d = df.select("*", p["after"].alias("__after"), p["reasoning"].alias("out_reasoning"))
    d = d.select("*", TF.clean_sql(F.col("__after")).alias("__clean")).drop("__after")
    return d.select("*", TF.drop_sql_prefix(F.col("__clean")).alias("out_sql")).drop("__clean")


def _extract_layers(df: DataFrame, text: str, out: str) -> DataFrame:
    d = _split_layers(df, text)
    d = d.select("*", F.when(F.col("out_sql") == "", F.coalesce(F.col(text), F.lit(""))).otherwise(F.col("out_sql"))
                 .alias("__s"))
    d = d.select("*", TF.keyword_position(F.col("__s")).alias("__pos"))
    d = d.select("*", TF.line_start_from(F.col("__s"), F.col("__pos")).alias("__start"))
    return d.select("*", TF.extract_from(F.col("__s"), F.col("__start")).alias(out))


def _per_text(df: DataFrame, texts: list[Column], work: Callable[[DataFrame], DataFrame], out: list[str],
              dedupe: bool) -> DataFrame:
    """``df`` with the columns ``out`` that ``work`` adds to a frame of ``__t0``, ``__t1``...

    With ``dedupe``, each distinct text is worked on once, on all cores, and joined
    back by a plain join that AQE can split; without, every row is, and nothing moves
    (better when nearly every text is unique).
    """
    names = [f"__t{k}" for k in range(len(texts))]
    named = df.withColumns(dict(zip(names, texts)))
    if not dedupe:
        return work(named).select(*df.columns, *out)
    done = work(spread(named.select(*names).distinct(), names[0], apart=False)).select(
        *[F.col(n).alias(f"{n}_of") for n in names], *[F.col(o).alias(f"__{o}") for o in out])
    same = reduce(and_, [F.col(n).eqNullSafe(F.col(f"{n}_of")) for n in names])
    return named.join(done, same).select(*[named[c] for c in df.columns], *[F.col(f"__{o}").alias(o) for o in out])


def split_outputs(df: DataFrame, text: str = "text", dedupe: bool = True) -> DataFrame:
    """EXT-01: adds ``out_sql`` and ``out_reasoning``."""
    return _per_text(df, [F.col(text)], lambda d: _split_layers(d, "__t0"), ["out_sql", "out_reasoning"], dedupe)


def extract_sql(df: DataFrame, text: str = "text", out: str = "extracted_sql", dedupe: bool = True) -> DataFrame:
    """EXT-02: adds ``out`` (fenced block / statement block / '')."""
    return _per_text(df, [F.col(text)], lambda d: _extract_layers(d, "__t0", out), [out], dedupe)


def extract_after_prompt(df: DataFrame, text: str = "text", prompt: str | None = None,
                         out: str = "extracted_sql", dedupe: bool = True) -> DataFrame:
    """EXT-03: adds ``out``; ``prompt`` names a column holding the prompt prefix.

    The response is what is taken apart once, so outputs that differ in their prompts alone count as one text.
    """
    response = TF.response_after_prompt(F.col(text), F.col(prompt) if prompt else F.lit(""))
    return _per_text(df, [response], lambda d: d.withColumn(out, TF.extract_from_response(F.col("__t0"))), [out], dedupe)


def repair_report(df: DataFrame, sql: str = "sql", query: str = "query") -> DataFrame:
    """FIX-01..05: table fix -> column fix -> question-based fix -> report columns.

    Table and column fixes depend on the SQL alone and are made once per distinct text.
    """
    sqls = spread(df.select(F.col(sql).alias("__sql")).distinct(), "__sql")
    t = TF.fix_table_names(F.col("__sql"))
    sqls = sqls.select("*", t["sql"].alias("__s1"), t["corrections"].alias("__c1"))
    c = TF.fix_column_case(F.col("__s1"))
    sqls = sqls.select("__sql", c["sql"].alias("__s2"), "__c1", c["corrections"].alias("__c2"))
    d = df.join(sqls, df[sql].eqNullSafe(sqls["__sql"]))
    q = F.coalesce(F.col(query), F.lit(""))
    ctx = TF.fix_from_question(F.col("__s2"), q)
    apply_ctx = ~TF.uses_domain_tables(F.col("__s2")) & (q != "")
    d = d.select("*", F.when(apply_ctx, ctx["sql"]).otherwise(F.col("__s2")).alias("__s3"),
                 F.when(apply_ctx, ctx["corrections"]).otherwise(F.array().cast("array<string>")).alias("__c3"))
    d = d.select("*", F.concat("__c1", "__c2", "__c3").alias("__corr"))
    r = TF.report(F.col(sql), F.col("__s3"), F.col("__corr"))
    return d.select("*", *[c.alias(k) for k, c in r.items()]).drop("__sql", "__c1", "__s2", "__c2", "__s3", "__c3", "__corr")
