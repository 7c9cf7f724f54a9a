"""COR-01..07, VAL-*, RWD-*, GRP-* queries over the candidate table.

Spark side: :mod:`tessera.operators.scoring`. Oracle side: the same layered
pipeline as DuckDB CTEs built from :mod:`tessera.plans.sqltext_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import sqltext as T
from ..operators import scoring as S
from . import sqltext_sql as X
from . import textfix_sql as XT
from .registry import query

# --------------------------------------------------------------- output specs
# kinds: c = as is, a = array joined with ' | ', d = double rounded to 6 places


def spark_out(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    sel = []
    for name, kind in cols:
        c = F.col(name)
        if kind == "a":
            c = F.array_join(c, " | ")
        elif kind == "d":
            c = S.r6(c)
        sel.append(c.alias(name))
    return df.select(*sel)


def sql_out(cols: list[tuple[str, str]], prefix: str = "") -> str:
    out = []
    for name, kind in cols:
        ref = prefix + name
        if kind == "a":
            out.append(f"array_to_string({ref}, ' | ') AS {name}")
        elif kind == "d":
            out.append(f"floor({ref} * 1000000 + 0.5) / 1000000 AS {name}")
        else:
            out.append(f"{ref} AS {name}")
    return ", ".join(out)


# --------------------------------------------------------------- SQL pipeline

_FEATS = X.sql_features("sql", "upper_sql")
_VAL = X.validate_sql("sql", {k: k for k in T.FEATURE_KEYS})
_COMP = X.validated_components({k: k for k in S.VAL_KEYS})
_COMP["syntax_reward"] = X.short_sql_guard("sql", _COMP["syntax_reward"])
_BASIC = {"syntax_reward_basic": X.syntax_reward_basic("sql"), "schema_reward_basic": X.schema_reward_basic("sql"),
          "business_reward_basic": X.business_reward_basic("sql"),
          "performance_reward_basic": X.performance_reward_basic("sql")}


def _cols(d: dict[str, str]) -> str:
    return ",\n  ".join(f"{expr} AS {k}" for k, expr in d.items())


_UPPER = f"{X.masked_upper('sql')} AS upper_sql"
SQL_FEATURES = f"""su AS (SELECT sql, {_UPPER} FROM sq),
sf AS (SELECT sql, upper_sql, {_cols({k: _FEATS[k] for k in T.FEATURE_KEYS if k != "upper_sql"})} FROM su),
sv AS (SELECT *, {_cols({k: _VAL[k] for k in S.VAL_KEYS})} FROM sf)"""

DISTINCT_SQL = f"sq AS (SELECT DISTINCT sql FROM candidates),\n{SQL_FEATURES}"

SCORED = f"""c AS (SELECT * FROM candidates),
sq AS (SELECT DISTINCT sql, expected_sql FROM c),
su AS (SELECT sql, expected_sql, {_UPPER} FROM sq),
sf AS (SELECT sql, expected_sql, upper_sql, {_cols({k: _FEATS[k] for k in T.FEATURE_KEYS if k != "upper_sql"})} FROM su),
sv AS (SELECT *, {_cols({k: _VAL[k] for k in S.VAL_KEYS})} FROM sf),
sr AS (SELECT *, {_cols(_COMP)}, {_cols(_BASIC)}, {X.accuracy_reward('sql', 'expected_sql')} AS accuracy_reward FROM sv),
sc AS (SELECT c.*, sr.* EXCLUDE (sql, expected_sql), {X.reasoning_reward('c.reasoning', 'c.query')} AS reasoning_reward
  FROM c JOIN sr ON c.sql IS NOT DISTINCT FROM sr.sql AND c.expected_sql IS NOT DISTINCT FROM sr.expected_sql),
scored AS (SELECT *, {X.total_reward(*S.COMPONENTS)} AS total_reward FROM sc)"""


def _sqls(v) -> DataFrame:
    return S.validate(S.spread(v.candidates.select("sql").distinct(), "sql"))


def _scored(v) -> DataFrame:
    return S.score(v.candidates)


def per_sql(name: str, cols: list[tuple[str, str]], extra_spark=None, extra_sql: dict[str, str] | None = None):
    """Register a query over the distinct candidate SQL texts."""
    extra_sql = extra_sql or {}
    sel = ", ".join([f"{e} AS {k}" for k, e in extra_sql.items()])
    inner = f"SELECT *{', ' + sel if sel else ''} FROM sv"
    sql = f"WITH {DISTINCT_SQL},\nx AS ({inner})\nSELECT sql, {sql_out(cols)} FROM x"

    @query(name, sql)
    def build(v, _cols=cols, _extra=extra_spark):
        d = _sqls(v)
        if _extra:
            d = d.select("*", *[c.alias(k) for k, c in _extra(d).items()])
        return spark_out(d, [("sql", "c"), *_cols])
    return build


def per_row(name: str, cols: list[tuple[str, str]], extra_spark=None, extra_sql: dict[str, str] | None = None):
    """Register a query over scored candidate rows."""
    extra_sql = extra_sql or {}
    sel = ", ".join([f"{e} AS {k}" for k, e in extra_sql.items()])
    inner = f"SELECT *{', ' + sel if sel else ''} FROM scored"
    key = [("prompt_id", "c"), ("cand_id", "c"), ("sql", "c")]
    sql = f"WITH {SCORED},\nx AS ({inner})\nSELECT {sql_out(key + cols)} FROM x"

    @query(name, sql)
    def build(v, _cols=cols, _extra=extra_spark):
        d = _scored(v)
        if _extra:
            d = d.select("*", *[c.alias(k) for k, c in _extra(d).items()])
        return spark_out(d, key + _cols)
    return build


# --------------------------------------------------------------- COR-01..07

per_sql("cor_01", [("norm_sql", "c")], lambda d: {"norm_sql": T.normalize_sql(F.col("sql"))},
        {"norm_sql": X.normalize_sql("sql")})
per_sql("cor_02", [("norm_sql_eval", "c")], lambda d: {"norm_sql_eval": T.normalize_sql_eval(F.col("sql"))},
        {"norm_sql_eval": X.normalize_sql_eval("sql")})
_STX = X.sql_structure("sql")
per_sql("cor_03", [("s_query_type", "c"), ("s_tables", "a"), ("s_has_where", "c"), ("s_has_join", "c"),
                   ("s_has_group_by", "c"), ("s_has_order_by", "c"), ("s_has_limit", "c")],
        lambda d: {"s_" + k: c for k, c in T.sql_structure(F.col("sql")).items()},
        {"s_" + k: e for k, e in _STX.items()})
per_sql("cor_04", [("n_joins", "c"), ("join_tables", "a"), ("tables", "a"), ("has_where", "c"),
                   ("n_aggregations", "c"), ("group_by", "a"), ("order_by", "a"), ("limit_value", "c"),
                   ("select_items", "a")])
per_sql("cor_05", [("joins", "a")], lambda d: {"joins": T.join_details(F.col("sql"))},
        {"joins": X.join_details("sql")})
per_sql("cor_06", [("complexity", "d"), ("where_subquery", "c")])
per_sql("cor_07", [("cost_class", "c"), ("advice", "a")])

# --------------------------------------------------------------- VAL-01..10

per_sql("val_01", [("syntax_errors", "a"), ("syntax_valid", "c")])
per_sql("val_02", [("schema_errors", "a"), ("schema_compliant", "c")])
per_sql("val_03", [("business_errors", "a"), ("business_valid", "c")])
per_sql("val_04", [("aggregation_errors", "a"), ("plain_columns", "a")])
per_sql("val_05", [("performance_warnings", "a"), ("performance_acceptable", "c"), ("optimizations", "a")])
per_sql("val_06", [("security_warnings", "a"), ("security_passed", "c")])
per_sql("val_07", [("suggestions", "a")])
per_sql("val_08", [("confidence", "d")])
per_row("val_09", [("is_valid_strict", "c"), ("is_valid_lax", "c"), ("confidence", "d")])

_LAYERS = {"syntax": "syntax_errors", "schema": "schema_errors", "business": "business_errors",
           "performance": "performance_warnings", "security": "security_warnings"}
_VAL10_SQL = (f"WITH {SCORED},\nu AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS layer, unnest({c}) AS issue FROM scored" for n, c in _LAYERS.items())
    + ")\nSELECT layer, issue, count(*) AS n FROM u GROUP BY layer, issue")


@query("val_10", _VAL10_SQL)
def val_10(v):
    return S.issue_summary(_scored(v))


# --------------------------------------------------------------- RWD-01..13

per_row("rwd_01", [("syntax_reward", "d"), ("syntax_reward_basic", "d")])
per_row("rwd_02", [("schema_reward", "d"), ("schema_reward_basic", "d")])
per_row("rwd_03", [("business_reward", "d"), ("business_reward_basic", "d")])
per_row("rwd_04", [("performance_reward", "d"), ("performance_reward_basic", "d")])
per_row("rwd_05", [("reasoning_reward", "d")])
per_row("rwd_06", [("accuracy_reward", "d")])
per_row("rwd_07", [(c, "d") for c in S.COMPONENTS] + [("total_reward", "d")])
per_row("rwd_08", [("feedback", "a"), ("should_update", "c")],
        lambda d: {"feedback": T.reward_feedback({k: F.col(k) for k in S.COMPONENTS}),
                   "should_update": F.col("total_reward") > 0},
        {"feedback": X.reward_feedback({k: k for k in S.COMPONENTS}), "should_update": "total_reward > 0"})
_GC = [*S.COMPONENTS, "total_reward"]
_GV = ["syntax_errors", "schema_errors", "business_errors", "suggestions"]
per_row("rwd_09", [("graded_feedback", "a")],
        lambda d: {"graded_feedback": T.graded_feedback({k: F.col(k) for k in _GC}, {k: F.col(k) for k in _GV})},
        {"graded_feedback": X.graded_feedback({k: k for k in _GC}, {k: k for k in _GV})})
per_row("rwd_10", [("should_train", "c"), ("train_weight", "d")],
        lambda d: S.training_signal(),
        {"should_train": "total_reward > 0 OR (is_valid_strict AND total_reward > -1)",
         "train_weight": "greatest(0.1, least(2.0, abs(total_reward) / 10))"})
per_row("rwd_11", [("notebook_reward", "d")],
        lambda d: {"notebook_reward": T.notebook_reward(F.col("sql"), F.col("query"), F.col("reasoning"))},
        {"notebook_reward": X.notebook_reward("sql", "query", "reasoning")})
per_row("rwd_12", [("generator_confidence", "d")],
        lambda d: {"generator_confidence": T.generator_confidence(F.col("sql"), F.col("reasoning"))},
        {"generator_confidence": X.generator_confidence("sql", "reasoning")})

_RANK_ORDER = "generator_confidence DESC, cand_id, sql, reasoning"


@query("rwd_13", f"""WITH r AS (SELECT prompt_id, cand_id, sql, reasoning, floor({X.generator_confidence('sql', 'reasoning')} * 1000000 + 0.5) / 1000000 AS generator_confidence
  FROM candidates),
k AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {_RANK_ORDER}) AS conf_rank FROM r)
SELECT prompt_id, cand_id, sql, generator_confidence,
CAST(conf_rank AS INTEGER) AS conf_rank, conf_rank = 1 AS is_best,
CASE (conf_rank - 1) % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE 0.9 END AS temperature FROM k""")
def rwd_13(v):
    c = v.candidates.select("prompt_id", "cand_id", "sql", "reasoning",
                            S.r6(T.generator_confidence(F.col("sql"), F.col("reasoning"))).alias("generator_confidence"))
    # equal confidences are ties, whatever the order they were added up in
    from ..operators.ordered import nth_within
    k = nth_within(c.withColumn("__negc", -F.col("generator_confidence")), ["prompt_id"], "__negc",
                   ["cand_id", "sql", "reasoning"], out="conf_rank").drop("__negc")
    temp = F.element_at(F.array(*[F.lit(t) for t in (0.3, 0.5, 0.7, 0.9)]), ((F.col("conf_rank") - 1) % 4 + 1).cast("int"))
    return k.select("prompt_id", "cand_id", "sql", "generator_confidence",
                    "conf_rank", (F.col("conf_rank") == 1).alias("is_best"), temp.alias("temperature"))


# --------------------------------------------------------------- GRP-01..09

_GSTATS = """gm AS (SELECT prompt_id, count(*) AS group_size, sum(CAST(floor(total_reward * 1000 + 0.5) AS BIGINT)) AS s_m,
  sum(CAST(floor(total_reward * 1000 + 0.5) AS BIGINT) * CAST(floor(total_reward * 1000 + 0.5) AS BIGINT)) AS q_m,
  max(total_reward) AS group_max, min(total_reward) AS group_min FROM scored GROUP BY prompt_id),
gv AS (SELECT *, CAST(s_m AS DOUBLE) / group_size AS mean_m,
  greatest(0.0, CAST(q_m AS DOUBLE) / group_size - (CAST(s_m AS DOUBLE) / group_size) * (CAST(s_m AS DOUBLE) / group_size)) AS var_m FROM gm),
g AS (SELECT *, sqrt(var_m) AS std_m, mean_m / 1000 AS group_mean, var_m / 1000000 AS group_var,
  sqrt(var_m) / 1000 AS group_std FROM gv)"""
_RM = "CAST(floor(s.total_reward * 1000 + 0.5) AS BIGINT)"


@query("grp_01", f"""WITH {SCORED},\n{_GSTATS}
SELECT s.prompt_id, s.cand_id, s.sql, floor(s.total_reward * 1000000 + 0.5) / 1000000 AS total_reward,
floor(CASE WHEN g.std_m > 0 THEN ({_RM} - g.mean_m) / g.std_m ELSE ({_RM} - g.mean_m) / 1000 END
 * 1000000 + 0.5) / 1000000 AS advantage
FROM scored s JOIN g ON s.prompt_id = g.prompt_id""")
def grp_01(v):
    a = S.group_advantage(S.rewards(v.candidates, "prompt_id", "cand_id", "sql"))
    return spark_out(a, [("prompt_id", "c"), ("cand_id", "c"), ("sql", "c"), ("total_reward", "d"), ("advantage", "d")])


@query("grp_02", f"""WITH {SCORED},
sm AS (SELECT count(*) AS n, sum(CAST(floor(total_reward * 1000 + 0.5) AS BIGINT)) AS s_m,
  sum(CAST(floor(total_reward * 1000 + 0.5) AS BIGINT) * CAST(floor(total_reward * 1000 + 0.5) AS BIGINT)) AS q_m FROM scored),
st AS (SELECT (CAST(s_m AS DOUBLE) / n) / 1000 AS m,
  sqrt(greatest(0.0, CAST(q_m AS DOUBLE) / n - (CAST(s_m AS DOUBLE) / n) * (CAST(s_m AS DOUBLE) / n))) / 1000 AS s FROM sm)
SELECT prompt_id, cand_id, sql, floor(greatest(-5.0, least(5.0,
  (CAST(floor(total_reward * 1000 + 0.5) AS BIGINT) / 1000 - st.m) / (st.s + 1e-8))) * 1000000 + 0.5)
 / 1000000 AS global_advantage FROM scored, st""")
def grp_02(v):
    a = S.global_advantage(S.rewards(v.candidates, "prompt_id", "cand_id", "sql"))
    return spark_out(a, [("prompt_id", "c"), ("cand_id", "c"), ("sql", "c"), ("global_advantage", "d")])


@query("grp_03", f"""WITH {SCORED},\n{_GSTATS}
SELECT s.prompt_id, s.cand_id, s.sql,
floor(CASE WHEN g.group_std > 1e-8 THEN (({_RM} - g.mean_m) / 1000) / (g.group_std + 1e-8)
 ELSE ({_RM} - g.mean_m) / 1000 END * 1000000 + 0.5) / 1000000 AS advantage
FROM scored s JOIN g ON s.prompt_id = g.prompt_id""")
def grp_03(v):
    a = S.group_advantage(S.rewards(v.candidates, "prompt_id", "cand_id", "sql"), variant="eps")
    return spark_out(a, [("prompt_id", "c"), ("cand_id", "c"), ("sql", "c"), ("advantage", "d")])


@query("grp_04", f"""WITH {SCORED},\n{_GSTATS}
SELECT prompt_id, floor(-(g.group_max - g.group_mean) * 1000000 + 0.5) / 1000000 AS loss,
floor((g.group_max - g.group_mean) * 1000000 + 0.5) / 1000000 AS best_advantage FROM g""")
def grp_04(v):
    st = S.group_stats(_scored(v))
    best = F.col("group_max") - F.col("group_mean")
    return st.select("prompt_id", S.r6(-best).alias("loss"), S.r6(best).alias("best_advantage"))


_BW = """bw AS (SELECT prompt_id,
  min(struct_pack(k := -total_reward, cand_id := cand_id, sql := sql, reasoning := reasoning, r := total_reward)) AS best,
  min(struct_pack(k := total_reward, cand_id := cand_id, sql := sql, reasoning := reasoning, r := total_reward)) AS worst
  FROM scored GROUP BY prompt_id)"""


@query("grp_05", f"""WITH {SCORED},\n{_GSTATS},\n{_BW}
SELECT g.prompt_id, bw.best.cand_id AS best_cand_id, floor(bw.best.r * 1000000 + 0.5) / 1000000 AS best_reward,
floor(g.group_mean * 1000000 + 0.5) / 1000000 AS baseline, floor(g.group_var * 1000000 + 0.5) / 1000000 AS variance,
floor(g.group_max * 1000000 + 0.5) / 1000000 AS max_reward, floor(g.group_min * 1000000 + 0.5) / 1000000 AS min_reward
FROM g JOIN bw ON g.prompt_id = bw.prompt_id""")
def grp_05(v):
    j = S.best_worst(_scored(v), row=("cand_id",))
    return j.select("prompt_id", F.col("best.cand_id").alias("best_cand_id"), S.r6("best.r").alias("best_reward"),
                    S.r6("group_mean").alias("baseline"), S.r6("group_var").alias("variance"),
                    S.r6("group_max").alias("max_reward"), S.r6("group_min").alias("min_reward"))


@query("grp_06", f"""WITH {SCORED},\n{_GSTATS},\n{_BW},
t AS (SELECT bw.prompt_id, 'positive' AS kind, bw.best.cand_id AS cand_id, bw.best.sql AS sql, bw.best.r AS reward, g.group_mean, g.group_std
  FROM bw JOIN g ON bw.prompt_id = g.prompt_id
  UNION ALL SELECT bw.prompt_id, 'negative', bw.worst.cand_id, bw.worst.sql, bw.worst.r, g.group_mean, g.group_std
  FROM bw JOIN g ON bw.prompt_id = g.prompt_id)
SELECT prompt_id, kind, cand_id, sql, floor(reward * 1000000 + 0.5) / 1000000 AS reward,
floor(CASE WHEN group_std > 0 THEN (reward - group_mean) / group_std ELSE reward - group_mean END * 1000000 + 0.5) / 1000000 AS advantage
FROM t""")
def grp_06(v):
    b = S.best_worst(_scored(v), row=("cand_id", "sql"))

    def side(kind, col):
        r = F.col(f"{col}.r")
        c = r - F.col("group_mean")
        adv = F.when(F.col("group_std") > 0, c / F.col("group_std")).otherwise(c)
        return F.struct(F.lit(kind).alias("kind"), F.col(f"{col}.cand_id").alias("cand_id"),
                        F.col(f"{col}.sql").alias("sql"), S.r6(r).alias("reward"), S.r6(adv).alias("advantage"))
    # both rows of a group from one pass
    return b.select("prompt_id", F.explode(F.array(side("positive", "best"), side("negative", "worst"))).alias("x")) \
        .select("prompt_id", "x.*")


_PAIR_SCORED = SCORED.replace("c AS (SELECT * FROM candidates)", f"""c AS (
  SELECT pair_id AS prompt_id, 0 AS cand_id, query, sql, reasoning, sql AS expected_sql, 'chosen' AS side FROM pairs
  UNION ALL
  SELECT pair_id, 1, query, {X.q(P.REJECTED_SQL)}, '', sql, 'rejected' FROM pairs)""")


@query("grp_07", f"""WITH {_PAIR_SCORED}
SELECT prompt_id AS pair_id, max(CASE WHEN side = 'chosen' THEN query END) AS prompt,
max(CASE WHEN side = 'chosen' THEN sql END) AS chosen_sql, {X.q(P.REJECTED_SQL)} AS rejected_sql,
floor(max(CASE WHEN side = 'chosen' THEN total_reward END) * 1000000 + 0.5) / 1000000 AS chosen_reward,
floor(max(CASE WHEN side = 'rejected' THEN total_reward END) * 1000000 + 0.5) / 1000000 AS rejected_reward,
floor((max(CASE WHEN side = 'chosen' THEN total_reward END) - max(CASE WHEN side = 'rejected' THEN total_reward END))
 * 1000000 + 0.5) / 1000000 AS advantage FROM scored GROUP BY prompt_id""")
def grp_07(v):
    p = S.preference_pairs(v.pairs)
    return spark_out(p, [("pair_id", "c"), ("prompt", "c"), ("chosen_sql", "c"), ("rejected_sql", "c"),
                         ("chosen_reward", "d"), ("rejected_reward", "d"), ("advantage", "d")])


@query("grp_08", f"""WITH {SCORED},\n{_BW}
SELECT prompt_id, bw.best.cand_id AS best_cand_id, bw.best.sql AS best_sql,
floor(bw.best.r * 1000000 + 0.5) / 1000000 AS best_reward FROM bw WHERE bw.best.r > 5""")
def grp_08(v):
    b = S.best_worst(_scored(v), row=("cand_id", "sql")).where(F.col("best.r") > 5)
    return b.select("prompt_id", F.col("best.cand_id").alias("best_cand_id"), F.col("best.sql").alias("best_sql"),
                    S.r6("best.r").alias("best_reward"))


@query("grp_09", f"""WITH {SCORED},
u AS (SELECT md5(query || '|' || sql) AS k, min(struct_pack(p := prompt_id, c := cand_id, r := total_reward,
  v := is_valid_strict)) AS first FROM scored GROUP BY md5(query || '|' || sql)),
m AS (SELECT count(*) AS n, sum(CASE WHEN first.v THEN 1 ELSE 0 END) AS n_valid,
  sum(CAST(floor(first.r * 1000 + 0.5) AS BIGINT)) AS s_m,
  sum(CAST(floor(first.r * 1000 + 0.5) AS BIGINT) * CAST(floor(first.r * 1000 + 0.5) AS BIGINT)) AS q_m,
  max(first.r) AS mx, min(first.r) AS mn FROM u)
SELECT n AS n_unique, floor(100.0 * n_valid / n * 1000000 + 0.5) / 1000000 AS valid_pct,
floor((CAST(s_m AS DOUBLE) / n) / 1000 * 1000000 + 0.5) / 1000000 AS mean_reward,
floor(mx * 1000000 + 0.5) / 1000000 AS max_reward, floor(mn * 1000000 + 0.5) / 1000000 AS min_reward,
floor(sqrt(greatest(0.0, CAST(q_m AS DOUBLE) / n - (CAST(s_m AS DOUBLE) / n) * (CAST(s_m AS DOUBLE) / n))) / 1000
 * 1000000 + 0.5) / 1000000 AS std_reward FROM m""")
def grp_09(v):
    """GRP-09: statistics over unique evaluations (first per md5(query|sql))."""
    s = _scored(v)
    k = F.md5(F.concat_ws("|", "query", "sql"))
    first = s.groupBy(k.alias("k")).agg(F.min(F.struct(F.col("prompt_id").alias("p"), F.col("cand_id").alias("c"),
                                                        F.col("total_reward").alias("r"),
                                                        F.col("is_valid_strict").alias("v"))).alias("first"))
    return S.reward_stats(first.select(F.col("first.r").alias("r"), F.col("first.v").alias("v")), "r", "v")


@query("str_04", f"""WITH {SCORED}
SELECT prompt_id, cand_id, sql, is_valid_strict, floor(total_reward * 1000000 + 0.5) / 1000000 AS total_reward FROM scored""",
       raw=True)
def str_04(spark, sf_dir):
    """STR-04: streaming validation + scoring of arriving candidates (stateless)."""
    from ..streaming import streams as STR
    from .registry import views
    out = STR.scored_candidates_stream(spark, sf_dir, views(spark, sf_dir).pairs)
    return out.select("prompt_id", "cand_id", "sql", "is_valid_strict", S.r6("total_reward").alias("total_reward"))


# --------------------------------------------------------------- JOIN-12, UDF-01..03

per_sql("join_12", [("n_joins", "c"), ("tables", "a"), ("cartesian_risk", "c")],
        lambda d: {"cartesian_risk": (F.size("tables") > 1) & (F.col("n_joins") < F.size("tables") - 1)},
        {"cartesian_risk": "(len(tables) > 1 AND n_joins < len(tables) - 1)"})


_ST = X.sql_structure("sql")


@query("udf_01", f"""WITH d AS (SELECT DISTINCT sql FROM candidates)
SELECT sql, {X.normalize_sql('sql')} AS norm_sql, {XT.uses_domain_tables('sql')} AS uses_domain,
floor({X.sql_features('sql')['complexity']} * 1000000 + 0.5) / 1000000 AS complexity, {_ST['query_type']} AS query_type,
array_to_string({_ST['tables']}, ' | ') AS tables, {_ST['has_join']} AS has_join, {_ST['has_limit']} AS has_limit FROM d""", raw=True)
def udf_01(spark, sf_dir):
    """UDF-01: the same functions called from SQL after ``register_functions``."""
    from ..functions.udfs import register_functions
    from .registry import views
    register_functions(spark)
    views(spark, sf_dir).candidates.select("sql").distinct().createOrReplaceTempView("tessera_candidate_sql")
    return spark.sql("""SELECT sql, tessera_normalize_sql(sql) AS norm_sql, tessera_uses_domain_tables(sql) AS uses_domain,
        floor(tessera_complexity_score(sql) * 1000000 + 0.5) / 1000000 AS complexity, st.query_type,
        array_join(st.tables, ' | ') AS tables, st.has_join, st.has_limit
        FROM (SELECT sql, tessera_sql_structure(sql) AS st FROM tessera_candidate_sql)""")


@query("udf_03", f"""WITH {SCORED}
SELECT prompt_id, cand_id, sql, floor((total_reward + CASE WHEN contains(upper(sql), 'LIMIT') THEN 0.5 ELSE 0.0 END)
 * 1000000 + 0.5) / 1000000 AS total_reward FROM scored""")
def udf_03(v):
    """UDF-03: a custom reward hook (+0.5 for bounded result sets) folded into the total."""
    from ..functions.udfs import score_with

    def limit_bonus(df):
        return df.withColumn("custom_reward", F.when(F.upper("sql").contains("LIMIT"), 0.5).otherwise(0.0))
    s = score_with(_scored(v), limit_bonus)
    return spark_out(s, [("prompt_id", "c"), ("cand_id", "c"), ("sql", "c"), ("total_reward", "d")])
