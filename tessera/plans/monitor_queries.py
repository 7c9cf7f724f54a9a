"""MON-01..12 over the run / request logs, with DuckDB twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..operators import sketches as SK
from ..operators.erp import rounded
from .registry import query

CURSOR = dt.datetime(2024, 1, 15)  # fixed: poll cursor for the incremental read
_LEVEL = """CASE WHEN contains(message, 'ERROR') OR contains(message, 'Failed') THEN 'error'
WHEN contains(message, 'WARNING') THEN 'warning' WHEN contains(message, 'SUCCESS') OR contains(message, '✓') THEN 'success'
WHEN contains(lower(message), 'epoch') OR contains(lower(message), 'loss') THEN 'progress' ELSE 'info' END"""
_FLEVEL = """CASE WHEN contains(message, 'ERROR') OR contains(message, 'Error') OR contains(message, 'error') THEN 'error'
WHEN contains(message, 'WARNING') OR contains(message, 'Warning') THEN 'warning'
WHEN contains(message, 'Installing') OR contains(message, 'Installed') OR contains(message, '✓') THEN 'success'
WHEN contains(message, 'ImportError') OR contains(message, 'ModuleNotFoundError') OR contains(message, 'Traceback') THEN 'error'
ELSE 'info' END"""


@query("mon_01", f"SELECT event_id, run_id, {_LEVEL} AS level, {_FLEVEL} AS fetched_level FROM run_logs")
def mon_01(v):
    l = v.run_logs
    return l.select("event_id", "run_id", M.log_level(F.col("message")).alias("level"),
                    M.fetched_log_level(F.col("message")).alias("fetched_level"))


@query("mon_02", f"SELECT run_id, {_LEVEL} AS level, CAST(ts AS DATE) AS day, count(*) AS n FROM run_logs GROUP BY 1, 2, 3")
def mon_02(v):
    return M.log_summary(v.run_logs)


@query("mon_03", """SELECT event_id, run_id, ts, message, max(ts) OVER (PARTITION BY run_id) AS next_cursor
FROM run_logs WHERE ts > TIMESTAMP '2024-01-15 00:00:00'""")
def mon_03(v):
    return M.incremental_read(v.run_logs, CURSOR).select("event_id", "run_id", "ts", "message", "next_cursor")


@query("mon_04", """SELECT event_id, run_id, status, prev_status FROM (SELECT *, lag(status) OVER (PARTITION BY run_id
ORDER BY ts, event_id) AS prev_status FROM run_logs) WHERE prev_status IS NULL OR status <> prev_status""")
def mon_04(v):
    return M.status_changes(v.run_logs).select("event_id", "run_id", "status", "prev_status")


_PRICE = "CASE inst " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in M.INSTANCE_PRICES) + " END"


@query("mon_05", f"""WITH p AS (SELECT run_id, min(ts) AS started, max(ts) AS ended, max(instance) AS inst FROM run_logs GROUP BY run_id),
s AS (SELECT run_id, CAST(epoch(date_trunc('second', ended)) - epoch(date_trunc('second', started)) AS BIGINT) AS seconds,
  inst FROM p)
SELECT run_id, seconds, CASE WHEN seconds // 3600 > 0 THEN printf('%dh %dm %ds', seconds // 3600, (seconds % 3600) // 60, seconds % 60)
WHEN (seconds % 3600) // 60 > 0 THEN printf('%dm %ds', (seconds % 3600) // 60, seconds % 60) ELSE printf('%ds', seconds % 60) END AS duration,
inst AS instance, floor(seconds / 3600.0 * {_PRICE} * 100 + 0.5) / 100 AS cost FROM s""")
def mon_05(v):
    return M.run_cost(v.run_logs)


@query("mon_06", """WITH l AS (SELECT run_id, max(struct_pack(ts := ts, event_id := event_id, status := status)) AS l FROM run_logs GROUP BY run_id),
f AS (SELECT run_id, max(struct_pack(ts := ts, event_id := event_id, message := message)) AS f FROM run_logs WHERE status = 'Failed' GROUP BY run_id)
SELECT l.run_id, l.l.status AS status, CASE WHEN l.l.status = 'Failed' THEN f.f.message END AS failure_reason
FROM l LEFT JOIN f ON l.run_id = f.run_id WHERE l.l.status IN ('Completed', 'Failed', 'Stopped')""")
def mon_06(v):
    return M.terminal_runs(v.run_logs)


@query("mon_07", """SELECT request_id, session_id, recency FROM (SELECT request_id, session_id, CAST(row_number() OVER
(PARTITION BY session_id ORDER BY ts DESC, request_id DESC) AS INTEGER) AS recency FROM requests) WHERE recency <= 100""")
def mon_07(v):
    return M.latest_per_key(v.requests, "session_id", 100, ["ts", "request_id"]).select(
        "request_id", "session_id", F.col("recency").cast("int"))


_ST = "[" + ", ".join(f"'{s}'" for s in M.STAGES) + "]"


@query("mon_08", f"""WITH d AS (SELECT session_id, list_position({_ST}, stage) AS stage_no, failed FROM requests),
g AS (SELECT session_id, max(stage_no) AS furthest, min(CASE WHEN failed THEN stage_no END) AS err FROM d GROUP BY session_id)
SELECT session_id, {_ST}[furthest] AS furthest_stage, CASE WHEN err IS NOT NULL THEN {_ST}[err] END AS error_stage FROM g""")
def mon_08(v):
    return M.stage_outcomes(v.requests)


_HITS = """f AS (SELECT cache_key, min(struct_pack(ts := ts, request_id := request_id)) AS first FROM requests GROUP BY cache_key),
h AS (SELECT r.*, NOT (r.ts = f.first.ts AND r.request_id = f.first.request_id) AS is_hit FROM requests r JOIN f ON r.cache_key = f.cache_key)"""


def _mean(x: str) -> str:
    return f"sum(CAST(floor({x} * 1000000 + 0.5) AS BIGINT)) / count({x}) / 1000000"


@query("mon_09", f"""WITH {_HITS},
g AS (SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS window_start, {_mean('latency_s')} AS response_time,
  {_mean('CAST(failed AS DOUBLE)')} AS error_rate, {_mean('CAST(is_hit AS DOUBLE)')} AS cache_hit_rate,
  {_mean('confidence')} AS confidence FROM h GROUP BY 1),
a AS (SELECT window_start, 'response_time_gt_5s' AS rule, response_time AS value FROM g WHERE response_time > 5.0
  UNION ALL SELECT window_start, 'error_rate_gt_1pct', error_rate FROM g WHERE error_rate > 0.01
  UNION ALL SELECT window_start, 'cache_hit_lt_70pct', cache_hit_rate FROM g WHERE cache_hit_rate < 0.70
  UNION ALL SELECT window_start, 'confidence_lt_0.5', confidence FROM g WHERE confidence < 0.5)
SELECT window_start, rule, floor(value * 1000000 + 0.5) / 1000000 AS value FROM a""")
def mon_09(v):
    a = M.alerts(M.cache_hits(v.requests))
    return a.select("window_start", "rule", rounded("value", 6).alias("value"))


@query("mon_10", """SELECT floor(quantile_cont(latency_s, 0.5) * 1000000 + 0.5) / 1000000 AS p50,
floor(quantile_cont(latency_s, 0.95) * 1000000 + 0.5) / 1000000 AS p95,
floor(quantile_cont(latency_s, 0.99) * 1000000 + 0.5) / 1000000 AS p99,
(SELECT avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) FROM requests) AS error_rate,
(SELECT avg(CASE WHEN failed THEN 0.0 ELSE 1.0 END) FROM requests) AS success_rate FROM requests""")
def mon_10(v):
    return M.exact_quantiles(
        v.requests, "latency_s", [0.5, 0.95, 0.99],
        F.avg(F.when(F.col("failed"), 1.0).otherwise(0.0)).alias("error_rate"),
        F.avg(F.when(F.col("failed"), 0.0).otherwise(1.0)).alias("success_rate"),
    ).select(rounded("p50", 6).alias("p50"), rounded("p95", 6).alias("p95"), rounded("p99", 6).alias("p99"),
             "error_rate", "success_rate")


@query("mon_10_rollup", """SELECT CAST(ts AS DATE) AS day, count(latency_s) AS n, quantile_disc(latency_s, 0.5) AS p50,
quantile_disc(latency_s, 0.95) AS p95, quantile_disc(latency_s, 0.99) AS p99 FROM requests GROUP BY 1""")
def mon_10_rollup(v):
    """MON-10 at scale: quantile sketches per hour, merged per day; exact while a day fits into a sketch."""
    hourly = SK.quantile_sketches(v.requests, [F.date_trunc("hour", "ts").alias("hour")], "latency_s")
    return SK.merged_quantiles(hourly, [F.col("hour").cast("date").alias("day")], {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("mon_11", """SELECT session_id, count(*) AS requests, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS failed_requests,
max(ts) AS last_request FROM requests GROUP BY session_id""")
def mon_11(v):
    return v.requests.groupBy("session_id").agg(F.count(F.lit(1)).alias("requests"),
                                                F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("failed_requests"),
                                                F.max("ts").alias("last_request"))


@query("mon_12", f"""WITH {_HITS} SELECT count(*) AS requests, sum(CASE WHEN is_hit THEN 1 ELSE 0 END) AS hits,
sum(CASE WHEN is_hit THEN 1 ELSE 0 END) / count(*) AS hit_rate FROM h""")
def mon_12(v):
    h = M.cache_hits(v.requests)
    return h.agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(F.col("is_hit"), 1).otherwise(0)).alias("hits"),
                 (F.sum(F.when(F.col("is_hit"), 1).otherwise(0)) / F.count(F.lit(1))).alias("hit_rate"))


# --------------------------------------------------------------- STR-01..04 (Structured Streaming)

from ..streaming import streams as STR  # noqa: E402


@query("str_01", f"""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start, run_id, {_LEVEL} AS level, count(*) AS n
FROM run_logs GROUP BY 1, 2, 3""", raw=True)
def str_01(spark, sf_dir):
    return STR.error_counts_by_day(spark, sf_dir)


@query("str_02", """SELECT cache_key, r.request_id AS request_id, r.ts AS ts, r.confidence AS confidence FROM (
SELECT cache_key, min(struct_pack(ts := CAST(ts AS TIMESTAMP), request_id := request_id, confidence := confidence)) AS r
FROM requests GROUP BY cache_key)""", raw=True)
def str_02(spark, sf_dir):
    return STR.first_per_key(spark, sf_dir)


@query("str_03", """SELECT event_id, run_id, status, prev_status FROM (SELECT *, lag(status) OVER (PARTITION BY run_id
ORDER BY ts, event_id) AS prev_status FROM run_logs) WHERE prev_status IS NULL OR status <> prev_status""", raw=True)
def str_03(spark, sf_dir):
    return STR.status_changes(spark, sf_dir)
