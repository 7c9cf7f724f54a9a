"""SRC-01..11: round trips through files derived (by Spark) from the driver tables.

Every query first writes a file set produced from the given tables into a fresh
folder under ``spark.checkpoint.dir`` and then reads it back with the library's
reader, so its work grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import evaluate as E
from ..operators import scoring as S
from ..sources import io as IO
from ..storage import scratch_path
from . import eval_queries as EV
from .registry import query

STAMP = dt.datetime(2024, 1, 31)  # fixed: report timestamp


def _pairs_jsonl(v, corrupt_every: int | None = None):
    """Pairs as JSONL text: every 5th row omits ``domain`` (default applies);
    optionally every n-th line is truncated (malformed)."""
    p = v.pairs
    full = F.to_json(F.struct("pair_id", "query", "sql", "reasoning", "domain"))
    partial = F.to_json(F.struct("pair_id", "query", "sql", "reasoning"))
    line = F.when(F.col("pair_id") % 5 == 0, partial).otherwise(full)
    if corrupt_every:
        line = F.when(F.col("pair_id") % corrupt_every == 0, F.substring(line, 1, 40)).otherwise(line)
    out = scratch_path(v.spark, "pairs-jsonl")
    p.select(line.alias("value")).write.text(out)
    return out


@query("src_01", """SELECT pair_id, query, sql, reasoning, 'medium' AS difficulty,
CASE WHEN pair_id % 5 = 0 THEN 'general' ELSE domain END AS domain FROM pairs""")
def src_01(v):
    path = _pairs_jsonl(v)
    good, _ = IO.split_corrupt(IO.read_pairs(v.spark, path))
    return good.select("pair_id", "query", "sql", "reasoning", "difficulty", "domain")


@query("src_02", """SELECT 'good' AS kind, count(*) AS n FROM pairs WHERE pair_id % 97 <> 0
UNION ALL SELECT 'corrupt', count(*) FROM pairs WHERE pair_id % 97 = 0""")
def src_02(v):
    path = _pairs_jsonl(v, corrupt_every=97)
    good, bad = IO.split_corrupt(IO.read_pairs(v.spark, path))
    g = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("kind"), "n")
    b = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("corrupt").alias("kind"), "n")
    return g.unionByName(b)


@query("src_02_lines", """SELECT 'part=' || CAST(pair_id % 4 AS VARCHAR) AS part, line, substr(raw, 1, 40) AS raw FROM (
SELECT pair_id, row_number() OVER (PARTITION BY pair_id % 4 ORDER BY pair_id) AS line, '{"pair_id":' || CAST(pair_id AS VARCHAR)
|| ',"query":"' || query || '"' AS raw FROM pairs) WHERE pair_id % 97 = 0""")
def src_02_lines(v):
    """SRC-02: file and line of every malformed line; four texts, each in the order of its ids.

    A text is a folder's files, each a range of its ids, so no task sorts a whole text.
    """
    p = v.pairs
    whole = F.to_json(F.struct("pair_id", "query", "sql", "reasoning", "domain"))
    line = F.when(F.col("pair_id") % 97 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    out = scratch_path(v.spark, "pairs-lines")
    (p.select((F.col("pair_id") % 4).alias("part"), "pair_id", line.alias("value")).repartitionByRange("part", "pair_id")
     .sortWithinPartitions("part", "pair_id").select("part", "value").write.partitionBy("part").text(out))
    found = IO.malformed_lines(v.spark, f"{out}/part=*", folders=True)
    return found.select(F.regexp_extract("source_file", r"(part=\d+)", 1).alias("part"), "line", "raw")


@query("src_03", """SELECT pair_id, 0 AS request_no, query, '' AS context FROM pairs WHERE pair_id % 2 = 0
UNION ALL SELECT pair_id, 0, query, domain FROM pairs WHERE pair_id % 2 = 1
UNION ALL SELECT pair_id, 1, query || ' (again)', '' FROM pairs WHERE pair_id % 2 = 1""")
def src_03(v):
    p = v.pairs
    one = F.to_json(F.struct("query"))
    many = F.to_json(F.array(F.struct("query", F.col("domain").alias("context")),
                             F.struct(F.concat("query", F.lit(" (again)")).alias("query"), F.lit("").alias("context"))))
    payloads = p.select("pair_id", F.when(F.col("pair_id") % 2 == 0, one).otherwise(many).alias("payload"))
    return IO.read_requests(payloads).select("pair_id", F.col("request_no").cast("int"), "query", "context")


@query("src_04", "SELECT pair_id, query, sql FROM pairs")
def src_04(v):
    out = scratch_path(v.spark, "jsonl")
    IO.write_jsonl(v.pairs.select("pair_id", "query", "sql"), out)
    return v.spark.read.schema("pair_id long, query string, sql string").json(out)


@query("src_05", """SELECT query, sql, reasoning, domain FROM pairs
UNION ALL SELECT query, sql, reasoning, NULL FROM candidates""")
def src_05(v):
    base = v.pairs.select("query", "sql", "reasoning", "domain")
    new = v.candidates.select("query", "sql", "reasoning")
    return IO.append_pairs(base, new)


@query("src_06", """WITH s0 AS (SELECT *, md5(concat_ws('|', CAST(pair_id AS VARCHAR), '42')) AS h FROM pairs),
s1 AS (SELECT *, row_number() OVER (ORDER BY h, pair_id) AS rn, count(*) OVER () AS n FROM s0)
SELECT pair_id, query FROM s1 WHERE rn > n - floor(n * 0.1) - floor(n * 0.1) AND rn <= n - floor(n * 0.1)""")
def src_06(v):
    out = scratch_path(v.spark, "processed")
    split = C.split_exact(v.pairs)
    stats = C.dataset_stats(v.pairs.withColumn("difficulty", C.difficulty_label(F.col("sql"))))
    IO.save_processed(split.select("pair_id", "query", "sql", "split"), stats, out, STAMP)
    return IO.load_processed(v.spark, out, "val").select("pair_id", "query")


@query("src_09", """SELECT run_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS timestamp, message FROM run_logs""")
def src_09(v):
    out = scratch_path(v.spark, "logs-json")
    v.run_logs.select("run_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("timestamp"),
                      "message").write.json(out)
    return IO.read_run_logs(v.spark, out).select("run_id", "timestamp", "message")


@query("src_09_tail", """SELECT run_id, timestamp, message, poll, max(timestamp) OVER (PARTITION BY run_id, poll) + 1 AS next_cursor
FROM (SELECT run_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS timestamp, message,
  CASE WHEN ts > TIMESTAMP '2024-01-15 00:00:00' THEN 2 ELSE 1 END AS poll FROM run_logs)""")
def src_09_tail(v):
    """SRC-09 / MON-03: two polls of a growing log folder; the second gives what came since the first."""
    from ..streaming.streams import tail_run_logs
    logs, state = scratch_path(v.spark, "log-pages"), scratch_path(v.spark, "tail")
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("timestamp")
    later = F.col("ts") > F.lit(dt.datetime(2024, 1, 15))
    polls = []
    for number, rows in ((1, v.run_logs.where(~later)), (2, v.run_logs.where(later))):
        rows.select("run_id", millis, "message").write.mode("append").json(logs)
        polls.append(tail_run_logs(v.spark, logs, state, page_files=4).withColumn("poll", F.lit(number)))
    return polls[0].unionByName(polls[1]).select("run_id", "timestamp", "message", "poll", "next_cursor")


@query("src_10", "SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] ' || message AS value FROM run_logs")
def src_10(v):
    out = scratch_path(v.spark, "logs-text")
    IO.write_log_text(v.run_logs, out)
    return v.spark.read.text(out)


@query("src_11", f"""WITH {EV._REC}, m AS ({EV._metrics_sql()})
SELECT prompt_id, cand_id, model, is_correct, floor(reward_score * 1000000 + 0.5) / 1000000 AS reward_score,
(SELECT total FROM m) AS total, (SELECT correct FROM m) AS correct, (SELECT errors FROM m) AS errors,
TIMESTAMP '2024-01-31 00:00:00' AS generated_at FROM rec""")
def src_11(v):
    """SRC-11: metrics and per-model detail records written as one report; both sides read back."""
    out = scratch_path(v.spark, "eval-report")
    r = EV._records(v)
    IO.write_eval_report(E.metrics(r), r.select("prompt_id", "cand_id", "model", "is_correct", "reward_score"),
                         out, STAMP)
    metrics, results = IO.read_eval_report(v.spark, out)
    one = metrics.select(F.struct("total", "correct", "errors", "generated_at")).scalar()  # a one-row file
    return results.select("prompt_id", "cand_id", "model", "is_correct", S.r6("reward_score").alias("reward_score"),
                          one.alias("m")).select("*", "m.*").drop("m")
