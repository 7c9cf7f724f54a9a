"""Candidate scoring: features -> validation -> reward -> group statistics.

Plan shape (one job):

* per-SQL work (regex features, five validation layers) runs once per distinct
  SQL text, the edit distance once per distinct ``(sql, expected_sql)`` pair. The
  distincts are map-side-combined aggregates, so a hot SQL template shared by a
  third of all rows collapses before the shuffle;
* texts and pairs are joined among themselves, and the scores are joined back on the (null-safe) texts themselves — no hash key,
  so no collision risk; the distinct side, one row a key, is hashed and the other streams past it
  unsorted, so a hot text costs a task no memory;
* per-row work that depends on the row (reasoning reward, totals) is a plain
  projection;
* group statistics use ``groupBy(prompt_id)`` partial aggregation plus a join,
  never a window over a hot prompt.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import sqltext as T
from ..functions.editdistance import edit_distance
from ..storage import written
from .erp import rounded

VAL_KEYS = ["syntax_errors", "schema_errors", "business_errors", "aggregation_errors", "performance_warnings",
            "optimizations", "security_warnings", "suggestions", "syntax_valid", "schema_compliant",
            "business_valid", "performance_acceptable", "security_passed", "confidence", "is_valid_strict",
            "is_valid_lax"]
COMPONENTS = ["syntax_reward", "schema_reward", "business_reward", "performance_reward", "reasoning_reward",
              "accuracy_reward"]


def r6(c: Column | str) -> Column:
    return rounded(c, 6)


@lru_cache(maxsize=None)
def _feature_cols(sql: str) -> tuple[Column, ...]:
    # Column trees are session-independent; building them once saves thousands
    # of Py4J calls per query.
    f = T.sql_features(F.col(sql), F.col("upper_sql"))
    return tuple(f[k].alias(k) for k in T.FEATURE_KEYS if k != "upper_sql")


@lru_cache(maxsize=None)
def _issue_cols(sql: str) -> tuple[Column, ...]:
    v = T.validation_issues(F.col(sql), {k: F.col(k) for k in T.FEATURE_KEYS})
    return tuple(v[k].alias(k) for k in T.ISSUE_KEYS)


@lru_cache(maxsize=None)
def _summary_cols() -> tuple[Column, ...]:
    v = T.validation_summary({k: F.col(k) for k in T.ISSUE_KEYS}, {k: F.col(k) for k in T.FEATURE_KEYS})
    return tuple(c.alias(k) for k, c in v.items())


@lru_cache(maxsize=None)
def _reward_cols(validated: bool) -> tuple[Column, ...]:
    s = F.col("sql")
    basic = {"syntax_reward_basic": T.syntax_reward_basic(s), "schema_reward_basic": T.schema_reward_basic(s),
             "business_reward_basic": T.business_reward_basic(s),
             "performance_reward_basic": T.performance_reward_basic(s)}
    if validated:
        comp = T.validated_components({k: F.col(k) for k in VAL_KEYS})
        comp["syntax_reward"] = T.short_sql_guard(s, comp["syntax_reward"])
    else:
        comp = {k.replace("_basic", ""): c for k, c in basic.items()}
    comp.update(basic)
    return tuple(c.alias(k) for k, c in comp.items())


@lru_cache(maxsize=None)
def _accuracy_input_cols() -> tuple[Column, ...]:
    i = T.accuracy_inputs(F.col("sql"), F.col("expected_sql"), F.col("__gen"), F.col("__exp"))
    return tuple(i[k].alias(k) for k in T.ACCURACY_INPUT_KEYS)


@lru_cache(maxsize=None)
def _side_cols(side: str, text: str) -> tuple[Column, ...]:
    """The accuracy inputs of one side (``gen`` or ``exp``), from the text alone and its ``upper_sql``."""
    i = T.accuracy_inputs(F.col(text), F.col(text), F.col("upper_sql"), F.col("upper_sql"))
    return tuple(i[k].alias(k) for k in T.ACCURACY_INPUT_KEYS if k.startswith(f"acc_{side}_"))


@lru_cache(maxsize=None)
def _similarity_col() -> Column:
    gen, exp = F.col("acc_gen_norm"), F.col("acc_exp_norm")
    differ = gen != exp
    distance = edit_distance(F.when(differ, gen), F.when(differ, exp))
    return F.when(differ, T.similarity(gen, exp, distance)).alias("__similarity")


@lru_cache(maxsize=None)
def _accuracy_col() -> Column:
    return T.accuracy_from({k: F.col(k) for k in T.ACCURACY_INPUT_KEYS}, F.col("__similarity")).alias("accuracy_reward")


@lru_cache(maxsize=None)
def _reasoning_input_cols() -> tuple[Column, ...]:
    i = T.reasoning_inputs(F.col("reasoning"), F.col("query"))
    return tuple(i[k].alias(k) for k in T.REASONING_INPUT_KEYS)


@lru_cache(maxsize=None)
def _reasoning_col() -> Column:
    return T.reasoning_from({k: F.col(k) for k in T.REASONING_INPUT_KEYS}).alias("reasoning_reward")


def with_features(df: DataFrame, sql: str = "sql") -> DataFrame:
    return df.withColumn("upper_sql", T.masked_upper(F.col(sql))).select("*", *_feature_cols(sql))


def validate(df: DataFrame, sql: str = "sql") -> DataFrame:
    """VAL-09 over a DataFrame: adds feature, issue and summary columns.

    Three projection layers (features -> issue arrays -> flags/confidence), so
    every regex and array is evaluated once per row even when several outputs
    depend on it.
    """
    return with_features(df, sql).select("*", *_issue_cols(sql)).select("*", *_summary_cols())


def spread(df: DataFrame, key: str | None = None, apart: bool = True) -> DataFrame:
    """Spread a CPU-heavy frame over all cores, by a hash of ``key`` or evenly.

    It is small in bytes, so AQE would coalesce it into a few tasks; the explicit
    partition count is twice the cluster's default parallelism, or the session's shuffle
    partitions, and one more: with the same count and key as the shuffle below it (a
    distinct), Spark would drop this one and leave that other to AQE. ``apart=False``
    leaves it so: rows joined back to a few texts then keep their order.
    """
    sc = df.sparkSession.sparkContext
    n = max(sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = 2 * n + 1 if apart else n
    return df.repartition(n, key) if key else df.repartition(n)


def _per_sql(sqls: DataFrame, validated: bool) -> DataFrame:
    """What depends on the SQL text alone: validation plus both reward modes.

    ``*_reward`` feed the total (validated or basic mode per ``validated``);
    ``*_reward_basic`` always carry the validation-free scores.
    """
    return validate(sqls, "sql").select("*", *_reward_cols(validated))


def _with_accuracy(pairs: DataFrame) -> DataFrame:
    """What depends on the SQL text and the expected one."""
    masked = pairs.withColumns({"__gen": T.masked_upper(F.coalesce("sql", F.lit(""))),
                                "__exp": T.masked_upper(F.col("expected_sql"))})
    return _compared(masked.select("*", *_accuracy_input_cols()).drop("__gen", "__exp"))


def _compared(inputs: DataFrame) -> DataFrame:
    """The accuracy from both sides' inputs; the edit distance is projected first, so it is found once a row."""
    return inputs.select("*", _similarity_col()).select("*", _accuracy_col()).drop("__similarity", *T.ACCURACY_INPUT_KEYS)


def _hashed(distinct: DataFrame) -> DataFrame:
    """The side of a join with one row a key: its share of each task is hashed, the other side streams past it.

    A sort-merge join would sort all rows of a hot text in one task. AQE still splits what grows too long.
    """
    return distinct.hint("shuffle_hash")


def _per_pair(pairs: DataFrame, validated: bool) -> DataFrame:
    """What depends on ``sql`` and ``expected_sql``: texts are taken apart once each, pairs only compared."""
    sqls = _per_sql(spread(pairs.select("sql").distinct(), "sql"), validated)
    blank = F.coalesce("sql", F.lit(""))
    sqls = (sqls.withColumnsRenamed({"upper_sql": "__upper"})
            .withColumns({"__text": blank, "upper_sql": F.coalesce("__upper", F.lit(""))})
            .select("*", *_side_cols("gen", "__text")).drop("__text", "upper_sql")
            .withColumnsRenamed({"__upper": "upper_sql", "sql": "__sql"}))
    expected = spread(pairs.select("expected_sql").distinct(), "expected_sql")
    expected = (expected.withColumn("upper_sql", T.masked_upper(F.col("expected_sql")))
                .select(F.col("expected_sql").alias("__expected"), *_side_cols("exp", "expected_sql")))
    both = (spread(pairs).join(_hashed(expected), F.col("expected_sql").eqNullSafe(F.col("__expected")))
            .join(_hashed(sqls), F.col("sql").eqNullSafe(F.col("__sql"))).drop("__expected", "__sql"))
    return _compared(both)


def _reasoned(rows: DataFrame) -> DataFrame:
    """What depends on the row's reasoning and question."""
    return rows.select("*", *_reasoning_input_cols()).select("*", _reasoning_col()).drop(*T.REASONING_INPUT_KEYS)


def score(df: DataFrame, validated: bool = True, dedupe: bool = True, more: dict[str, Column] | None = None) -> DataFrame:
    """Score every candidate row (columns ``sql, reasoning, query, expected_sql``).

    Adds features, validation results, the six reward components and
    ``total_reward``; columns that the caller doesn't select are pruned together
    with the work behind them. Validation is done once per distinct SQL text, the
    comparison once per distinct pair. The distinct pairs are written first, so what ``df`` is made
    from runs once for them and once for its rows; texts and pairs are joined among themselves, and
    the rows, of which there are many more, move once, to their pair, with the reasoning's score
    in place of its texts (unless the caller selects these). ``dedupe=False``
    computes it on every row instead, dealt evenly over all cores (better when nearly every
    SQL text is unique): rows cost a millisecond each but compress well, so AQE, which counts
    bytes, would leave them to a few tasks. ``more`` are further columns of ``sql`` and
    ``expected_sql``, found with the comparison.
    """
    more = more or {}
    if dedupe:
        pairs = written(df.select("sql", "expected_sql").distinct(), "pairs")
        scores = _per_pair(pairs, validated).withColumns(more).withColumnsRenamed({"sql": "__psql", "expected_sql": "__pexp"})
        same = df["sql"].eqNullSafe(scores["__psql"]) & df["expected_sql"].eqNullSafe(scores["__pexp"])
        rows = _reasoned(df).join(_hashed(scores), same, "inner").drop("__psql", "__pexp")
    else:
        rows = _reasoned(_with_accuracy(_per_sql(spread(df), validated)).withColumns(more))
    return rows.withColumn("total_reward", T.total_reward(*[F.col(c) for c in COMPONENTS]))


def rewards(df: DataFrame, *columns: str) -> DataFrame:
    """The scored rows with ``columns`` and ``total_reward`` only, written once.

    For results that read the rewards twice (rows and their group's moments): the
    second reading costs a narrow scan instead of a second scoring.
    """
    return written(score(df).select(*columns, "total_reward"), "rewards")


MILLI = 1000  # rewards are quantised to 1/1000 for exact group moments


def _milli(reward: str) -> Column:
    return F.floor(F.col(reward) * MILLI + 0.5).cast("long")


def group_stats(scored: DataFrame, group: str = "prompt_id", reward: str = "total_reward", *more: Column) -> DataFrame:
    """Per-group mean, population std / variance, max, min and the aggregates ``more``.

    Moments come from exact integer sums of the reward in 1/1000 units (sum,
    sum of squares, count): the aggregate is partial (map-side) and the result
    is bit-for-bit independent of the order rows arrive in, so reruns and other
    engines agree exactly.
    """
    g = scored.groupBy(group).agg(
        F.count(F.lit(1)).alias("group_size"), F.sum(_milli(reward)).alias("__s"),
        F.sum(_milli(reward) * _milli(reward)).alias("__q"),
        F.max(reward).alias("group_max"), F.min(reward).alias("group_min"), *more)
    extra = [c for c in g.columns if c not in (group, "group_size", "__s", "__q", "group_max", "group_min")]
    mean_m = F.col("__s") / F.col("group_size")
    var_m = F.greatest(F.lit(0.0), F.col("__q") / F.col("group_size") - mean_m * mean_m)
    return g.select(group, "group_size", "group_max", "group_min", mean_m.alias("__mean_m"),
                    F.sqrt(var_m).alias("__std_m"), (mean_m / MILLI).alias("group_mean"),
                    (var_m / (MILLI * MILLI)).alias("group_var"), (F.sqrt(var_m) / MILLI).alias("group_std"), *extra)


def group_advantage(scored: DataFrame, group: str = "prompt_id", reward: str = "total_reward",
                    variant: str = "standard") -> DataFrame:
    """GRP-01/03/04 advantages via a per-group aggregate joined back.

    * ``standard``: ``r - mean``, divided by the population std when std > 0;
    * ``eps``: divide by ``std + 1e-8`` only when ``std > 1e-8``;
    * ``centre``: ``r - mean`` only.
    """
    stats = group_stats(scored, group, reward)
    j = scored.join(stats, group, "inner")
    centred_m = _milli(reward) - F.col("__mean_m")
    centred = centred_m / MILLI
    if variant == "standard":
        adv = F.when(F.col("__std_m") > 0, centred_m / F.col("__std_m")).otherwise(centred)
    elif variant == "eps":
        adv = F.when(F.col("group_std") > 1e-8, centred / (F.col("group_std") + 1e-8)).otherwise(centred)
    elif variant == "centre":
        adv = centred
    else:
        raise ValueError(variant)
    return j.withColumn("advantage", adv).drop("__mean_m", "__std_m")


def global_advantage(scored: DataFrame, reward: str = "total_reward", clip: float = 5.0) -> DataFrame:
    """GRP-02: ``(r - mean) / (std + 1e-8)`` over the whole batch, clipped to ±clip.

    Mean and std come from one global aggregate (exact milli-unit moments) used
    as scalar subqueries — no window over the whole table.
    """
    st = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(_milli(reward)).alias("s"),
                    F.sum(_milli(reward) * _milli(reward)).alias("q"))
    mean_m = F.col("s") / F.col("n")
    var_m = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean_m * mean_m)
    # one scalar subquery returning both moments (the scored input is read once more, not twice)
    both = st.select(F.struct((mean_m / MILLI).alias("m"), (F.sqrt(var_m) / MILLI).alias("sd"))).scalar()
    m, sd = both["m"], both["sd"]
    adv = (_milli(reward) / MILLI - m) / (sd + 1e-8)
    return scored.withColumn("global_advantage", F.greatest(F.lit(-clip), F.least(F.lit(clip), adv)))


def reward_stats(df: DataFrame, reward: str, valid: str) -> DataFrame:
    """One-row statistics: count, valid %, mean, max, min, population std (exact moments)."""
    m = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(valid), 1).otherwise(0)).alias("n_valid"),
               F.sum(_milli(reward)).alias("s"), F.sum(_milli(reward) * _milli(reward)).alias("q"),
               F.max(reward).alias("mx"), F.min(reward).alias("mn"))
    mean_m = F.col("s") / F.col("n")
    var_m = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean_m * mean_m)
    return m.select(F.col("n").alias("n_unique"), r6(100.0 * F.col("n_valid") / F.col("n")).alias("valid_pct"),
                    r6(mean_m / MILLI).alias("mean_reward"), r6("mx").alias("max_reward"),
                    r6("mn").alias("min_reward"), r6(F.sqrt(var_m) / MILLI).alias("std_reward"))


def best_worst(scored: DataFrame, group: str = "prompt_id", reward: str = "total_reward",
               row: tuple[str, ...] = ("cand_id", "sql", "reasoning")) -> DataFrame:
    """GRP-05/06: first arg-max and first arg-min per group as structs, with the group's moments.

    Ties break on ``cand_id`` then ``sql`` then ``reasoning`` (explicit order
    instead of list position). One aggregate, reduced map-side, so a hot group is
    never gathered. It sorts a task's rows with all of ``row``: a caller that reads only the first of
    these names them alone, what follows breaks ties that it doesn't see.
    """
    best = F.min(F.struct((-F.col(reward)).alias("k"), *[F.col(c) for c in row], F.col(reward).alias("r")))
    worst = F.min(F.struct(F.col(reward).alias("k"), *[F.col(c) for c in row], F.col(reward).alias("r")))
    return group_stats(scored, group, reward, best.alias("best"), worst.alias("worst"))


def issue_summary(validated: DataFrame) -> DataFrame:
    """VAL-10: count of each issue per layer across rows."""
    layers = {"syntax": "syntax_errors", "schema": "schema_errors", "business": "business_errors",
              "performance": "performance_warnings", "security": "security_warnings"}
    def tag(name: str, col: str) -> Column:
        label = F.lit(name)
        return F.transform(F.col(col), lambda x: F.struct(label.alias("layer"), x.alias("issue")))

    tagged = F.concat(*[tag(n, c) for n, c in layers.items()])
    return (validated.select(F.explode(tagged).alias("i"))
            .groupBy(F.col("i.layer").alias("layer"), F.col("i.issue").alias("issue"))
            .agg(F.count(F.lit(1)).alias("n")))


def training_signal() -> dict[str, Column]:
    """RWD-10: train if total > 0 or (valid and total > -1); weight in [0.1, 2]."""
    t = F.col("total_reward")
    return {"should_train": (t > 0) | (F.col("is_valid_strict") & (t > -1)),
            "train_weight": F.greatest(F.lit(0.1), F.least(F.lit(2.0), F.abs(t) / 10))}


def preference_pairs(pairs: DataFrame, rejected_sql: str = P.REJECTED_SQL) -> DataFrame:
    """GRP-07: chosen = ground-truth SQL, rejected = a fixed poor SQL; both scored
    with the validated reward (against the ground truth); advantage = difference."""
    chosen = pairs.select("pair_id", "query", F.col("sql").alias("sql"), F.col("reasoning"),
                          F.col("sql").alias("expected_sql"), F.lit("chosen").alias("side"))
    rejected = pairs.select("pair_id", "query", F.lit(rejected_sql).alias("sql"), F.lit("").alias("reasoning"),
                            F.col("sql").alias("expected_sql"), F.lit("rejected").alias("side"))
    s = score(chosen.unionByName(rejected))
    g = s.groupBy("pair_id").agg(
        F.first("query").alias("prompt"),
        F.max(F.when(F.col("side") == "chosen", F.col("sql"))).alias("chosen_sql"),
        F.max(F.when(F.col("side") == "chosen", F.col("total_reward"))).alias("chosen_reward"),
        F.max(F.when(F.col("side") == "rejected", F.col("total_reward"))).alias("rejected_reward"))
    return g.select("pair_id", "prompt", "chosen_sql", F.lit(rejected_sql).alias("rejected_sql"),
                    "chosen_reward", "rejected_reward",
                    (F.col("chosen_reward") - F.col("rejected_reward")).alias("advantage"))
