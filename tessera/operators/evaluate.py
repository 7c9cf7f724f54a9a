"""Evaluation and model comparison (EVL-01..15).

Generations are extracted (EXT), scored once per distinct SQL (see
:mod:`.scoring`) and rolled up with plain aggregates. Means of decimal-valued
metrics are taken over exact integer sums (milli units) so results do not
depend on the order partitions are combined in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import sqltext as T
from ..functions import textfix as TF
from ..storage import written
from . import scoring as S
from .textops import split_outputs

RECALL_KEYWORDS = ["SELECT", "FROM", "WHERE", "JOIN", "GROUP BY", "ORDER BY", "HAVING"]
CHECKPOINT_DOMAIN_TABLES = ["PAC_MNT_PROJECTS", "SRM_COMPANIES", "PROJCNTRTS", "PROJSTAFF"]
DOMAIN_GATE = 0.8
RECALL_SCALE = 420  # lcm(1..7): keyword recall k/m becomes an exact integer


def exact_mean(c: Column | str, scale: int = 1000) -> Column:
    """Mean of a decimal-valued column via an exact integer sum (order independent)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(F.floor(c * scale + 0.5).cast("long")) / F.count(c) / scale


def rate(flag: Column | str) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(F.avg(F.when(flag, 1.0).otherwise(0.0)), F.lit(0.0))


def contains_any_case_sensitive(sql: Column, tables: list[str]) -> Column:
    out = None
    for t in tables:
        c = F.coalesce(sql, F.lit("")).contains(t)
        out = c if out is None else (out | c)
    return out


def with_extracted(generations: DataFrame) -> DataFrame:
    """``sql`` and ``reasoning`` in place of ``text``, row by row.

    Taking a text apart costs less than moving its row to the text's one result, and a text that many
    rows share gathers none of them in a task. The fallback's layers (EXT-02) see a text only where
    the split leaves nothing.
    """
    t = split_outputs(generations, "text", dedupe=False)
    t = t.select("*", F.when(F.col("out_sql") == "", F.col("text")).alias("__s"))
    t = t.select("*", TF.keyword_position(F.col("__s")).alias("__pos"))
    t = t.select("*", TF.line_start_from(F.col("__s"), F.col("__pos")).alias("__start"))
    return t.select(*[c for c in generations.columns if c != "text"],
                    F.when(F.col("out_sql") == "", TF.extract_from(F.col("__s"), F.col("__start")))
                    .otherwise(F.col("out_sql")).alias("sql"), F.col("out_reasoning").alias("reasoning"))


def eval_records(generations: DataFrame, questions: DataFrame) -> DataFrame:
    """EVL-01: one evaluation record per generation.

    ``questions`` maps ``prompt_id`` to ``query``. SQL comes from the think-split
    (EXT-01) and, when empty, from the fence / statement extractor (EXT-02). A null
    text counts as a failed generation: empty SQL, error set. The generations are written
    once, with their SQL in place of the text: they are read for their distinct pairs and for the
    records. Equal pairs of a task lie side by side, so they take little room there and on their way.
    """
    generations = generations.withColumn("text", F.coalesce("text", F.lit("")))
    g = with_extracted(generations.join(questions, "prompt_id", "inner")).withColumn(
        "has_reasoning", F.col("reasoning") != "")
    gen, exp = F.col("sql"), F.col("expected_sql")
    correct = ((gen != "") & F.coalesce(exp != "", F.lit(False))
               & (T.normalize_sql_eval(gen) == T.normalize_sql_eval(exp)))
    s = S.score(written(g.select("prompt_id", "cand_id", "model", "query", "expected_sql", "sql", "reasoning",
                                 "has_reasoning", "seconds", "error").sortWithinPartitions("expected_sql", "sql"),
                        "generations"),
                more={"is_correct": F.coalesce(correct, F.lit(False)), "uses_domain_tables":
                      contains_any_case_sensitive(gen, P.DOMAIN_TABLES)})
    return s.select(
        "prompt_id", "cand_id", "model", "query", "expected_sql", F.col("sql").alias("generated_sql"), "reasoning",
        "is_correct",
        ((gen != "") & F.col("syntax_valid")).alias("is_valid_syntax"),
        "uses_domain_tables",
        "has_reasoning",
        F.when(gen != "", F.col("total_reward")).otherwise(0.0).alias("reward_score"),
        "is_valid_strict", F.col("seconds").alias("generation_time"), "error")


def metrics(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL-02 / EVL-06: counts and rates (0 for an empty set), mean reward."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.sum(F.col("is_correct").cast("long")).alias("correct"),
            F.sum(F.col("is_valid_syntax").cast("long")).alias("valid_syntax"),
            F.sum(F.col("uses_domain_tables").cast("long")).alias("domain_tables"),
            F.sum(F.col("has_reasoning").cast("long")).alias("with_reasoning"),
            F.coalesce(exact_mean("reward_score"), F.lit(0.0)).alias("avg_reward"),
            F.coalesce(exact_mean("generation_time"), F.lit(0.0)).alias("avg_generation_time"),
            F.count("error").alias("errors")]
    g = records.groupBy(*by).agg(*aggs) if by else records.agg(*aggs)
    tot = F.col("total")
    return g.select(*(by or []), "total", "correct", "valid_syntax", "domain_tables", "with_reasoning",
                    F.when(tot > 0, F.col("correct") / tot).otherwise(0.0).alias("accuracy"),
                    F.when(tot > 0, F.col("valid_syntax") / tot).otherwise(0.0).alias("syntax_rate"),
                    F.when(tot > 0, F.col("domain_tables") / tot).otherwise(0.0).alias("domain_rate"),
                    F.when(tot > 0, F.col("with_reasoning") / tot).otherwise(0.0).alias("reasoning_rate"),
                    "avg_reward", "avg_generation_time", "errors")


def keyword_recall_x(gen: Column, ref: Column) -> Column:
    """EVL-05 keyword recall scaled by 420 (exact integer); 420 when the reference has none."""
    gu, ru = F.upper(F.coalesce(gen, F.lit(""))), F.upper(F.coalesce(ref, F.lit("")))
    in_ref = [F.when(ru.contains(k), 1).otherwise(0) for k in RECALL_KEYWORDS]
    both = [F.when(ru.contains(k) & gu.contains(k), 1).otherwise(0) for k in RECALL_KEYWORDS]
    m, k = sum(in_ref[1:], in_ref[0]), sum(both[1:], both[0])
    return F.when(m == 0, F.lit(RECALL_SCALE)).otherwise((k * RECALL_SCALE / m).cast("long"))


def batch_text_metrics(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """EVL-05: exact match (upper/trim), syntax (SELECT and FROM), keyword recall, mean |len diff|."""
    p, r = F.coalesce(F.col(pred), F.lit("")), F.coalesce(F.col(ref), F.lit(""))
    em = F.upper(TF.strip(p)) == F.upper(TF.strip(r))
    syn = F.upper(p).contains("SELECT") & F.upper(p).contains("FROM")
    n = F.count(F.lit(1))
    return df.agg((F.sum(em.cast("long")) / n).alias("exact_match"),
                  (F.sum(syn.cast("long")) / n).alias("syntax_valid"),
                  (F.sum(keyword_recall_x(p, r)) / RECALL_SCALE / n).alias("keyword_recall"),
                  (F.sum(F.abs(F.length(p) - F.length(r))) / n).alias("avg_length_diff"))


def checkpoint_comparison(records: DataFrame, base: str = "Base") -> DataFrame:
    """EVL-07: per model SQL-generated and domain-table rates and mean time, the best model per
    metric (ties by name) and each model's difference to ``base``."""
    per = records.groupBy("model").agg(
        rate(F.col("generated_sql") != "").alias("sql_rate"),
        rate(contains_any_case_sensitive(F.col("generated_sql"), CHECKPOINT_DOMAIN_TABLES)).alias("domain_rate"),
        exact_mean("generation_time").alias("mean_time"))

    # one row per model: a tiny, bounded frame
    def over_all(c: Column, *order) -> Column:
        return c.over(Window.orderBy(*(order or (F.lit(1),))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def to_base(name: str) -> Column:
        return F.col(name) - over_all(F.max(F.when(F.col("model") == base, F.col(name))))

    return per.select("model", "sql_rate", "domain_rate", "mean_time",
                      over_all(F.first("model"), F.col("sql_rate").desc(), "model").alias("best_by_sql_rate"),
                      over_all(F.first("model"), F.col("domain_rate").desc(), "model").alias("best_by_domain_rate"),
                      over_all(F.first("model"), F.col("mean_time").asc(), "model").alias("fastest"),
                      to_base("sql_rate").alias("sql_rate_vs_base"), to_base("domain_rate").alias("domain_rate_vs_base"),
                      to_base("mean_time").alias("mean_time_vs_base"))


def training_history(trajectories: DataFrame, run: Column, iteration: Column) -> DataFrame:
    """EVL-11: per run and iteration the mean reward and advantage, the policy loss (mean of minus
    advantage times log-probability) and the KL estimate exp(d) - d - 1 with d = reference minus policy.

    ``trajectories`` has total_reward, advantage, logp and ref_logp.
    """
    gap = F.col("ref_logp") - F.col("logp")
    return trajectories.groupBy(run.alias("run"), iteration.alias("iteration")).agg(
        F.count(F.lit(1)).alias("n"), exact_mean("total_reward").alias("mean_reward"),
        exact_mean("advantage", 1_000_000).alias("mean_advantage"),
        exact_mean(-F.col("advantage") * F.col("logp"), 1_000_000).alias("policy_loss"),
        exact_mean(F.exp(gap) - gap - 1, 1_000_000).alias("kl"))


def corrected_pairs(records: DataFrame) -> DataFrame:
    """EVL-15: the pairs that feedback adds to the corpus: wrong answers' questions with their corrected SQL."""
    wrong = records.where(~F.col("is_correct") & (F.coalesce("expected_sql", F.lit("")) != ""))
    return wrong.select("query", F.col("expected_sql").alias("sql"), F.lit("feedback").alias("domain")).distinct()
