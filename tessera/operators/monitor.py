"""Run-log and request-log monitoring (MON-01..12), batch form.

Per-key "latest n" uses ``row_number() <= n`` (Spark inserts a partial
WindowGroupLimit before the shuffle); "first occurrence" flags use a grouped
minimum joined back (partial aggregation), so a hot key never needs one task to
sort all of its rows. Percentiles are exact and distributed: running counts of the
distinct values locate the neighbouring order statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import exact_mean
from .ordered import lag_within, sums_before, time_span

# ---- fixed values: hourly prices per instance type (MON-05) ----
INSTANCE_PRICES = [("ml.g5.xlarge", 0.30), ("ml.g4dn.xlarge", 0.35), ("ml.p3.2xlarge", 1.15), ("ml.g5.2xlarge", 0.60)]
TERMINAL = ["Completed", "Failed", "Stopped"]
STAGES = ["schema_analysis", "query_generation", "validation", "reward_evaluation", "finalize"]
ALERT_RULES = [("response_time_gt_5s", 5.0), ("error_rate_gt_1pct", 0.01), ("cache_hit_lt_70pct", 0.70),
               ("confidence_lt_0.5", 0.5)]


def log_level(message: Column) -> Column:
    """MON-01 (monitor rules): first match wins."""
    m = F.coalesce(message, F.lit(""))
    lm = F.lower(m)
    return (F.when(m.contains("ERROR") | m.contains("Failed"), "error").when(m.contains("WARNING"), "warning")
            .when(m.contains("SUCCESS") | m.contains("✓"), "success")
            .when(lm.contains("epoch") | lm.contains("loss"), "progress").otherwise("info"))


def fetched_log_level(message: Column) -> Column:
    """MON-01 (fetched-log rules)."""
    m = F.coalesce(message, F.lit(""))
    return (F.when(m.contains("ERROR") | m.contains("Error") | m.contains("error"), "error")
            .when(m.contains("WARNING") | m.contains("Warning"), "warning")
            .when(m.contains("Installing") | m.contains("Installed") | m.contains("✓"), "success")
            .when(m.contains("ImportError") | m.contains("ModuleNotFoundError") | m.contains("Traceback"), "error")
            .otherwise("info"))


def log_summary(logs: DataFrame, per_day: bool = True) -> DataFrame:
    """MON-02: message counts per run and level (and day)."""
    keys = [F.col("run_id"), log_level(F.col("message")).alias("level")]
    if per_day:
        keys.append(F.to_date("ts").alias("day"))
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def incremental_read(logs: DataFrame, cursor) -> DataFrame:
    """MON-03 batch form: all events after the cursor, with the cursor of each run's next read."""
    new = logs.where(F.col("ts") > F.lit(cursor))
    return new.join(new.groupBy("run_id").agg(F.max("ts").alias("next_cursor")), "run_id")


def status_changes(logs: DataFrame) -> DataFrame:
    """MON-04: rows whose status differs from the run's previous status (skew-safe lag)."""
    d = lag_within(logs, ["run_id"], ["ts", "event_id"], "status", "prev_status", time_span("ts"))
    return d.where(F.col("prev_status").isNull() | (F.col("status") != F.col("prev_status")))


def format_duration(seconds: Column) -> Column:
    """``Xh Ym Zs`` / ``Ym Zs`` / ``Zs``."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), (s % 60)
    return (F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r))
            .otherwise(F.format_string("%ds", r)))


def run_cost(logs: DataFrame) -> DataFrame:
    """MON-05: duration and cost per run from its first to its last log line; ``instance`` is a column of the logs."""
    prices = F.create_map(*[x for t, p in INSTANCE_PRICES for x in (F.lit(t), F.lit(p))])
    per = logs.groupBy("run_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"),
                                     F.max("instance").alias("instance"))
    secs = F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("started").cast("timestamp"))
    return per.select("run_id", secs.alias("seconds"), format_duration(secs).alias("duration"), "instance",
                      (F.floor(secs / 3600.0 * F.element_at(prices, F.col("instance")) * 100 + 0.5) / 100).alias("cost"))


def terminal_runs(logs: DataFrame) -> DataFrame:
    """MON-06: runs whose latest status is terminal, with the failure reason."""
    last = logs.groupBy("run_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("l"))
    reason = (logs.where(F.col("status") == "Failed").groupBy("run_id")
              .agg(F.max(F.struct("ts", "event_id", "message")).alias("f")))
    j = last.join(reason, "run_id", "left").where(F.col("l.status").isin(*TERMINAL))
    return j.select("run_id", F.col("l.status").alias("status"),
                    F.when(F.col("l.status") == "Failed", F.col("f.message")).alias("failure_reason"))


def latest_per_key(df: DataFrame, key: str, n: int, order: list[str]) -> DataFrame:
    """MON-07: the newest ``n`` rows per key (group limit is pushed below the shuffle)."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def stage_outcomes(requests: DataFrame) -> DataFrame:
    """MON-08: furthest pipeline stage per session and the first stage that failed; ``stage`` is a column of the requests."""
    names = F.array(*[F.lit(s) for s in STAGES])
    number = F.array_position(names, F.col("stage")).cast("int")
    g = requests.groupBy("session_id").agg(F.max(number).alias("furthest"),
                                           F.min(F.when(F.col("failed"), number)).alias("err"))
    return g.select("session_id", F.element_at(names, F.col("furthest")).alias("furthest_stage"),
                    F.when(F.col("err").isNotNull(), F.element_at(names, F.col("err"))).alias("error_stage"))


def cache_hits(requests: DataFrame) -> DataFrame:
    """MON-12: a request is a hit when its cache key was seen at an earlier (ts, id)."""
    first = requests.groupBy("cache_key").agg(F.min(F.struct("ts", "request_id")).alias("__first"))
    j = requests.join(first, "cache_key")
    return j.withColumn("is_hit", ~((F.col("ts") == F.col("__first.ts"))
                                    & (F.col("request_id") == F.col("__first.request_id")))).drop("__first")


def alerts(requests_with_hits: DataFrame, window: str = "1 hour") -> DataFrame:
    """MON-09: windowed request metrics checked against the alert rules."""
    r = requests_with_hits
    g = r.groupBy(F.window(F.col("ts").cast("timestamp"), window).alias("w")).agg(
        # exact integer sums: a mean on a rule's limit doesn't depend on the order of the rows
        exact_mean("latency_s", 1_000_000).alias("response_time"),
        exact_mean(F.col("failed").cast("double"), 1_000_000).alias("error_rate"),
        exact_mean(F.col("is_hit").cast("double"), 1_000_000).alias("cache_hit_rate"),
        exact_mean("confidence", 1_000_000).alias("confidence"))
    checks = F.array(
        F.when(F.col("response_time") > 5.0, F.struct(F.lit("response_time_gt_5s").alias("rule"),
                                                       F.col("response_time").alias("value"))),
        F.when(F.col("error_rate") > 0.01, F.struct(F.lit("error_rate_gt_1pct").alias("rule"),
                                                    F.col("error_rate").alias("value"))),
        F.when(F.col("cache_hit_rate") < 0.70, F.struct(F.lit("cache_hit_lt_70pct").alias("rule"),
                                                        F.col("cache_hit_rate").alias("value"))),
        F.when(F.col("confidence") < 0.5, F.struct(F.lit("confidence_lt_0.5").alias("rule"),
                                                   F.col("confidence").alias("value"))))
    return (g.select(F.col("w.start").alias("window_start"), F.explode(F.array_compact(checks)).alias("a"))
            .select("window_start", "a.rule", "a.value"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], *more: Column) -> DataFrame:
    """MON-10: exact linear-interpolation quantiles (``quantile_cont``), one row.

    Counts per distinct value are summed up in value order, so each order
    statistic is the value whose range of positions holds it; rows are never
    sorted. ``more`` are aggregates over all rows of ``df``.
    """
    whole = df.agg(F.count(value).alias("__n"), *more)
    per = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    at = sums_before(per, F.col(value).asc(), "__c", "__before")
    n = at.agg(F.sum("__c")).scalar()

    def order_statistic(position: Column) -> Column:
        inside = (F.col("__before") <= position) & (position < F.col("__before") + F.col("__c"))
        return F.max(F.when(inside, F.col(value)))

    cols = []
    for p in probs:
        place = (n - 1) * p
        low, high = order_statistic(F.floor(place)), order_statistic(F.ceil(place))
        cols.append((low + (high - low) * (place - F.floor(place))).alias(f"p{int(round(p * 100))}"))
    # two one-row frames side by side
    one = at.agg(*cols).withColumn("__one", F.lit(1))
    return one.join(whole.withColumn("__one", F.lit(1)), "__one").drop("__one", "__n")
