"""EVL-01..15, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import sqltext as T
from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import scoring as S
from . import sqltext_sql as X
from . import textfix_sql as XT
from .registry import query
from .scoring_queries import SCORED

_SPLIT = XT.split_output("text")
_GEN = f"""g0 AS (SELECT g.prompt_id, g.cand_id, g.model, g.expected_sql, coalesce(g.text, '') AS text, g.seconds, g.error, p.query FROM generations g
  JOIN pairs p ON g.prompt_id = p.pair_id),
g1 AS (SELECT *, {_SPLIT['sql']} AS s_out, {_SPLIT['reasoning']} AS r_out, {XT.sql_candidate('text')} AS s_c FROM g0),
g2 AS (SELECT *, {XT.statement_start('s_c')} AS st FROM g1),
c AS (SELECT prompt_id, cand_id, model, query, expected_sql, seconds, error,
  CASE WHEN s_out = '' THEN {XT.extract_from('s_c', 'st')} ELSE s_out END AS sql, r_out AS reasoning FROM g2)"""
_SC = SCORED.replace("c AS (SELECT * FROM candidates)", _GEN)
_DOM = "(" + " OR ".join(f"contains(coalesce(sql, ''), '{t}')" for t in P.DOMAIN_TABLES) + ")"
_REC = f"""{_SC},
rec AS (SELECT prompt_id, cand_id, model, query, expected_sql, sql AS generated_sql, reasoning,
  coalesce(sql <> '' AND expected_sql <> '' AND {X.normalize_sql_eval('sql')} = {X.normalize_sql_eval('expected_sql')}, FALSE) AS is_correct,
  (sql <> '' AND syntax_valid) AS is_valid_syntax, {_DOM} AS uses_domain_tables, reasoning <> '' AS has_reasoning,
  CASE WHEN sql <> '' THEN total_reward ELSE 0.0 END AS reward_score, is_valid_strict, seconds AS generation_time, error FROM scored)"""


def _records(v):
    return E.eval_records(v.generations, v.pairs.select(F.col("pair_id").alias("prompt_id"), "query"))


def _r6(c):
    return S.r6(c)


def _metrics_sql(by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {g}count(*) AS total, sum(CAST(is_correct AS BIGINT)) AS correct,
sum(CAST(is_valid_syntax AS BIGINT)) AS valid_syntax, sum(CAST(uses_domain_tables AS BIGINT)) AS domain_tables,
sum(CAST(has_reasoning AS BIGINT)) AS with_reasoning,
coalesce(sum(CAST(floor(reward_score * 1000 + 0.5) AS BIGINT)) / count(reward_score) / 1000, 0.0) AS avg_reward,
coalesce(sum(CAST(floor(generation_time * 1000 + 0.5) AS BIGINT)) / count(generation_time) / 1000, 0.0) AS avg_generation_time,
count(error) AS errors
FROM rec{grp}"""


def _metrics_out(by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT {g}total, correct, valid_syntax, domain_tables, with_reasoning,
CASE WHEN total > 0 THEN correct / total ELSE 0.0 END AS accuracy,
CASE WHEN total > 0 THEN valid_syntax / total ELSE 0.0 END AS syntax_rate,
CASE WHEN total > 0 THEN domain_tables / total ELSE 0.0 END AS domain_rate,
CASE WHEN total > 0 THEN with_reasoning / total ELSE 0.0 END AS reasoning_rate,
floor(avg_reward * 1000000 + 0.5) / 1000000 AS avg_reward,
floor(avg_generation_time * 1000000 + 0.5) / 1000000 AS avg_generation_time, errors FROM m"""


def _metrics_spark(d):
    return d.withColumn("avg_reward", _r6("avg_reward")).withColumn("avg_generation_time", _r6("avg_generation_time"))


@query("evl_01", f"""WITH {_REC} SELECT prompt_id, cand_id, model, generated_sql, is_correct, is_valid_syntax,
uses_domain_tables, has_reasoning, floor(reward_score * 1000000 + 0.5) / 1000000 AS reward_score, generation_time, error FROM rec""")
def evl_01(v):
    r = _records(v)
    return r.select("prompt_id", "cand_id", "model", "generated_sql", "is_correct", "is_valid_syntax",
                    "uses_domain_tables", "has_reasoning", _r6("reward_score").alias("reward_score"), "generation_time",
                    "error")


@query("evl_02", f"WITH {_REC}, m AS ({_metrics_sql()}) {_metrics_out()}")
def evl_02(v):
    return _metrics_spark(E.metrics(_records(v)))


@query("evl_03", f"""WITH {_REC}, m AS ({_metrics_sql()}),
s AS (SELECT 0 AS line_no, 'Evaluated ' || CAST(total AS VARCHAR) || ' generations: ' || CAST(correct AS VARCHAR)
  || ' correct, ' || CAST(valid_syntax AS VARCHAR) || ' valid, ' || CAST(domain_tables AS VARCHAR) || ' with domain tables'
  AS line FROM m),
d AS (SELECT row_number() OVER (ORDER BY prompt_id, cand_id, generated_sql) AS line_no,
  CAST(prompt_id AS VARCHAR) || '/' || CAST(cand_id AS VARCHAR) || ' ' || model || ' correct=' ||
  CASE WHEN is_correct THEN 'true' ELSE 'false' END || ' sql=' || generated_sql AS line
  FROM (SELECT * FROM rec ORDER BY prompt_id, cand_id, generated_sql LIMIT 10))
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM s UNION ALL SELECT CAST(line_no AS INTEGER), line FROM d""")
def evl_03(v):
    """EVL-03: a text report — one summary line and the first ten detail lines."""
    r = _records(v)
    m = E.metrics(r)
    s = m.select(F.lit(0).alias("line_no"), F.concat(
        F.lit("Evaluated "), F.col("total").cast("string"), F.lit(" generations: "), F.col("correct").cast("string"),
        F.lit(" correct, "), F.col("valid_syntax").cast("string"), F.lit(" valid, "),
        F.col("domain_tables").cast("string"), F.lit(" with domain tables")).alias("line"))
    top = r.orderBy("prompt_id", "cand_id", "generated_sql").limit(10)
    top = top.withColumn("line_no", F.row_number().over(Window.orderBy("prompt_id", "cand_id", "generated_sql")))
    d = top.select(F.col("line_no").cast("int"), F.concat(
        F.col("prompt_id").cast("string"), F.lit("/"), F.col("cand_id").cast("string"), F.lit(" "), F.col("model"),
        F.lit(" correct="), F.when(F.col("is_correct"), "true").otherwise("false"), F.lit(" sql="),
        F.col("generated_sql")).alias("line"))
    return s.unionByName(d)


@query("evl_04", f"""WITH {_REC} SELECT coalesce(avg(CASE WHEN trim(generated_sql) = trim(coalesce(expected_sql, ''))
THEN 1.0 ELSE 0.0 END), 0.0) AS exact_match_rate FROM rec""")
def evl_04(v):
    r = _records(v)
    return r.agg(E.rate(F.trim("generated_sql") == F.trim(F.coalesce("expected_sql", F.lit("")))).alias("exact_match_rate"))


_RECALL_IN = [f"CASE WHEN contains(upper(coalesce(expected_sql, '')), '{k}') THEN 1 ELSE 0 END" for k in E.RECALL_KEYWORDS]
_RECALL_BOTH = [f"CASE WHEN contains(upper(coalesce(expected_sql, '')), '{k}') AND contains(upper(coalesce(generated_sql, '')), "
                f"'{k}') THEN 1 ELSE 0 END" for k in E.RECALL_KEYWORDS]
_M, _K = "(" + " + ".join(_RECALL_IN) + ")", "(" + " + ".join(_RECALL_BOTH) + ")"


@query("evl_05", f"""WITH {_REC} SELECT
sum(CAST(upper({XT.strip("coalesce(generated_sql, '')")}) = upper({XT.strip("coalesce(expected_sql, '')")}) AS BIGINT)) / count(*) AS exact_match,
sum(CAST(contains(upper(coalesce(generated_sql, '')), 'SELECT') AND contains(upper(coalesce(generated_sql, '')), 'FROM') AS BIGINT)) / count(*) AS syntax_valid,
sum(CASE WHEN {_M} = 0 THEN 420 ELSE CAST({_K} * 420 / {_M} AS BIGINT) END) / 420 / count(*) AS keyword_recall,
sum(abs(length(coalesce(generated_sql, '')) - length(coalesce(expected_sql, '')))) / count(*) AS avg_length_diff FROM rec""")
def evl_05(v):
    return E.batch_text_metrics(_records(v), "generated_sql", "expected_sql")


@query("evl_06", f"WITH {_REC}, m AS ({_metrics_sql('model')}) {_metrics_out('model')}")
def evl_06(v):
    return _metrics_spark(E.metrics(_records(v), ["model"]))


_CK = "(" + " OR ".join(f"contains(coalesce(generated_sql, ''), '{t}')" for t in E.CHECKPOINT_DOMAIN_TABLES) + ")"


_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query("evl_07", f"""WITH {_REC}, per AS (SELECT model, avg(CASE WHEN generated_sql <> '' THEN 1.0 ELSE 0.0 END) AS sql_rate,
  avg(CASE WHEN {_CK} THEN 1.0 ELSE 0.0 END) AS domain_rate,
  sum(CAST(floor(generation_time * 1000 + 0.5) AS BIGINT)) / count(generation_time) / 1000 AS mean_time FROM rec GROUP BY model)
SELECT model, sql_rate, domain_rate, mean_time,
first_value(model) OVER (ORDER BY sql_rate DESC, model {_ALL}) AS best_by_sql_rate,
first_value(model) OVER (ORDER BY domain_rate DESC, model {_ALL}) AS best_by_domain_rate,
first_value(model) OVER (ORDER BY mean_time, model {_ALL}) AS fastest,
sql_rate - max(CASE WHEN model = 'Base' THEN sql_rate END) OVER () AS sql_rate_vs_base,
domain_rate - max(CASE WHEN model = 'Base' THEN domain_rate END) OVER () AS domain_rate_vs_base,
mean_time - max(CASE WHEN model = 'Base' THEN mean_time END) OVER () AS mean_time_vs_base FROM per""")
def evl_07(v):
    return E.checkpoint_comparison(_records(v))


_DIFF = X.sql_features("expected_sql")["complexity"]


@query("evl_08", f"""WITH {_REC}, d AS (SELECT *, CASE WHEN {_DIFF} < 3 THEN 'easy' WHEN {_DIFF} < 6 THEN 'medium'
  ELSE 'hard' END AS difficulty FROM rec)
SELECT difficulty, count(*) AS n, sum(CAST(is_correct AS BIGINT)) AS correct,
sum(CAST(is_correct AS BIGINT)) / count(*) AS success_rate FROM d GROUP BY difficulty""")
def evl_08(v):
    r = _records(v).withColumn("difficulty", C.difficulty_label(F.col("expected_sql")))
    return r.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_correct").cast("long")).alias("correct"),
                                       (F.sum(F.col("is_correct").cast("long")) / F.count(F.lit(1))).alias("success_rate"))


@query("evl_09", f"""WITH {_REC}, m AS ({_metrics_sql('model')})
SELECT model, CASE WHEN total > 0 THEN domain_tables / total ELSE 0.0 END AS domain_rate,
CASE WHEN total > 0 THEN domain_tables / total ELSE 0.0 END > {E.DOMAIN_GATE} AS is_good FROM m""")
def evl_09(v):
    m = E.metrics(_records(v), ["model"])
    return m.select("model", "domain_rate", (F.col("domain_rate") > E.DOMAIN_GATE).alias("is_good"))


@query("evl_10", """WITH r AS (SELECT event_id, run_id, ts, seconds AS metric FROM run_logs),
b AS (SELECT *, max(metric) OVER w AS prev_best, min(metric) OVER w AS prev_least FROM r
  WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, run_id, metric, greatest(metric, coalesce(prev_best, metric)) AS best_so_far,
prev_best IS NULL OR metric > prev_best AS is_new_best, least(metric, coalesce(prev_least, metric)) AS least_so_far,
prev_least IS NULL OR metric < prev_least AS is_new_least FROM b""")
def evl_10(v):
    """EVL-10: best-so-far metric per run with strict-improvement flags, for a reward (largest)
    and a loss (smallest); the metric is run_logs.seconds."""
    from ..operators.ordered import running_extreme_before, time_span
    r = v.run_logs.select("event_id", "run_id", "ts", F.col("seconds").alias("metric"))
    order = ["ts", "event_id"]
    b = running_extreme_before(r, ["run_id"], order, "metric", "prev_best", time_span("ts"))
    b = running_extreme_before(b, ["run_id"], order, "metric", "prev_least", time_span("ts"), smallest=True)
    m, best, least = F.col("metric"), F.col("prev_best"), F.col("prev_least")
    return b.select("event_id", "run_id", "metric",
                    F.greatest(m, F.coalesce(best, m)).alias("best_so_far"), (best.isNull() | (m > best)).alias("is_new_best"),
                    F.least(m, F.coalesce(least, m)).alias("least_so_far"), (least.isNull() | (m < least)).alias("is_new_least"))


_ADV = """g AS (SELECT prompt_id, count(*) AS n, sum(CAST(floor(total_reward * 1000 + 0.5) AS BIGINT)) AS s_m,
  sum(CAST(floor(total_reward * 1000 + 0.5) AS BIGINT) * CAST(floor(total_reward * 1000 + 0.5) AS BIGINT)) AS q_m
  FROM scored GROUP BY prompt_id),
gv AS (SELECT *, CAST(s_m AS DOUBLE) / n AS mean_m,
  sqrt(greatest(0.0, CAST(q_m AS DOUBLE) / n - (CAST(s_m AS DOUBLE) / n) * (CAST(s_m AS DOUBLE) / n))) AS std_m FROM g),
a AS (SELECT s.prompt_id, s.total_reward, -CAST(length(s.sql) % 50 AS DOUBLE) / 10 AS logp,
  -CAST(length(s.expected_sql) % 50 AS DOUBLE) / 10 AS ref_logp, CASE WHEN gv.std_m > 0 THEN (CAST(floor(s.total_reward * 1000 + 0.5) AS BIGINT)
  - gv.mean_m) / gv.std_m ELSE (CAST(floor(s.total_reward * 1000 + 0.5) AS BIGINT) - gv.mean_m) / 1000 END AS advantage
  FROM scored s JOIN gv ON s.prompt_id = gv.prompt_id)"""


@query("evl_11", f"""WITH {SCORED},\n{_ADV}
SELECT CASE prompt_id % 3 WHEN 0 THEN 'Base' WHEN 1 THEN 'SFT' ELSE 'GRPO' END AS run, CAST(floor(prompt_id / 1000) AS BIGINT) AS iteration,
count(*) AS n, sum(CAST(floor(total_reward * 1000 + 0.5) AS BIGINT)) / count(*) / 1000 AS mean_reward,
sum(CAST(floor(advantage * 1000000 + 0.5) AS BIGINT)) / count(*) / 1000000 AS mean_advantage,
sum(CAST(floor(-advantage * logp * 1000000 + 0.5) AS BIGINT)) / count(*) / 1000000 AS policy_loss,
sum(CAST(floor((exp(ref_logp - logp) - (ref_logp - logp) - 1) * 1000000 + 0.5) AS BIGINT)) / count(*) / 1000000 AS kl
FROM a GROUP BY 1, 2""")
def evl_11(v):
    """EVL-11: training-history roll-up per (run, iteration) of scored candidates; the texts' lengths
    stand for the log-probabilities that a training log would hold."""
    a = S.group_advantage(S.rewards(v.candidates, "prompt_id", "sql", "expected_sql"))
    a = a.withColumn("logp", -(F.length("sql") % 50).cast("double") / 10) \
        .withColumn("ref_logp", -(F.length("expected_sql") % 50).cast("double") / 10)
    run = F.when(F.col("prompt_id") % 3 == 0, "Base").when(F.col("prompt_id") % 3 == 1, "SFT").otherwise("GRPO")
    return E.training_history(a, run, F.floor(F.col("prompt_id") / 1000).cast("long"))


@query("evl_12", """WITH l AS (SELECT 'run-' || CAST(user_id // 7 AS VARCHAR) AS run_id,
  CAST(regexp_extract(CASE event_type WHEN 'signup' THEN 'epoch 1 loss ' || CAST(event_id % 7 AS VARCHAR) ELSE '' END,
  'loss (\\d+)', 1) AS DOUBLE) AS loss FROM events WHERE event_type = 'signup')
SELECT run_id, count(*) AS n, avg(loss) AS mean_loss, floor(exp(avg(loss)) * 1000000 + 0.5) / 1000000 AS perplexity
FROM l GROUP BY run_id""")
def evl_12(v):
    """EVL-12: perplexity = exp(mean loss) per run, losses parsed from log messages."""
    l = (v.run_logs.where(F.col("message").startswith("epoch"))
         .select("run_id", F.regexp_extract("message", r"loss (\d+)", 1).cast("double").alias("loss")))
    return l.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"),
                                   S.r6(F.exp(F.avg("loss"))).alias("perplexity"))


@query("evl_13", """SELECT count(*) AS total, sum(CASE WHEN NOT (event_type = 'error') THEN 1 ELSE 0 END) AS successful,
sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed,
sum(CAST(floor(value / 10 * 1000 + 0.5) AS BIGINT)) / 1000 AS total_time,
sum(CAST(floor(value / 10 * 1000 + 0.5) AS BIGINT)) / count(*) / 1000 AS mean_time FROM events""")
def evl_13(v):
    """EVL-13: batch inference summary over the request log."""
    r = v.requests
    milli = F.floor(F.col("latency_s") * 1000 + 0.5).cast("long")
    return r.agg(F.count(F.lit(1)).alias("total"), F.sum(F.when(~F.col("failed"), 1).otherwise(0)).alias("successful"),
                 F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("failed"),
                 (F.sum(milli) / 1000).alias("total_time"), (F.sum(milli) / F.count(F.lit(1)) / 1000).alias("mean_time"))


@query("evl_14", f"""WITH {_REC} SELECT prompt_id, cand_id, floor(greatest(0.0, least(1.0, reward_score / 10)) * 1000000 + 0.5)
/ 1000000 AS service_confidence FROM rec""")
def evl_14(v):
    r = _records(v)
    return r.select("prompt_id", "cand_id",
                    S.r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("reward_score") / 10))).alias("service_confidence"))


_RATING = "greatest(1, least(5, CAST(floor(reward_score / 4) AS BIGINT) + 3))"


@query("evl_15", f"""WITH {_REC}, f AS (SELECT model, {_RATING} AS rating, is_correct FROM rec)
SELECT model, count(*) AS n_feedback, sum(rating) / count(*) AS avg_rating,
sum(CAST(is_correct AS BIGINT)) / count(*) AS correct_rate,
sum(CASE WHEN NOT is_correct THEN 1 ELSE 0 END) AS new_pairs FROM f GROUP BY model""")
def evl_15(v):
    """EVL-15: feedback roll-up (rating from the reward, correctness) and the number of
    corrected pairs it would add back to the corpus."""
    r = _records(v)
    rating = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.col("reward_score") / 4).cast("long") + 3))
    f = r.select("model", rating.alias("rating"), "is_correct")
    return f.groupBy("model").agg(F.count(F.lit(1)).alias("n_feedback"),
                                  (F.sum("rating") / F.count(F.lit(1))).alias("avg_rating"),
                                  (F.sum(F.col("is_correct").cast("long")) / F.count(F.lit(1))).alias("correct_rate"),
                                  F.sum(F.when(~F.col("is_correct"), 1).otherwise(0)).alias("new_pairs"))


@query("evl_15_pairs", f"""WITH {_REC} SELECT DISTINCT query, expected_sql AS sql, 'feedback' AS domain FROM rec
WHERE NOT is_correct AND coalesce(expected_sql, '') <> ''""")
def evl_15_pairs(v):
    """EVL-15: the corrected pairs themselves."""
    return E.corrected_pairs(_records(v))
