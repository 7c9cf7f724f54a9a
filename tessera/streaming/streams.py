"""Structured Streaming forms of the monitoring and scoring jobs (STR-01..04).

Sources are file streams over a table folder (``pathGlobFilter`` picks the
table). Every job takes ``out``: its sink, state and checkpoint live there, so a
call with the same folder goes on where the last one stopped; without it, a new
folder under ``spark.checkpoint.dir`` is used. A micro-batch writes its rows to a
folder of its own and overwrites it, so a batch that is replayed after a failure
adds nothing. What a job remembers between batches is in Spark's state store
(:mod:`.keyed`), by key, until a timer ends it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monitor as M
from ..operators import scoring as S
from ..sources.fixtures import cache_key, candidate_columns, run_log_columns
from ..sources.io import read_run_logs
from ..storage import scratch_path
from .keyed import CHANGE_ROW, FIRST_ROW, LOG_ROW, MARK, FirstPerKey, StatusChanges, first_of_each, state_store

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LINEITEM_SCHEMA = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                   "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                   "l_linestatus string, l_shipdate timestamp_ntz")


def table_stream(spark: SparkSession, sf_dir: str, table: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(sf_dir)


def run_logs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``run_logs`` view over a stream (event time cast to TIMESTAMP for watermarks)."""
    logs = run_log_columns(table_stream(spark, sf_dir, "events", EVENTS_SCHEMA))
    return logs.withColumn("ts", F.col("ts").cast("timestamp"))


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder, whole and at most once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
    return write


def run_to_end(stream: DataFrame, out: str, write: Callable[[DataFrame, int], None],
               mode: str = "append") -> dt.datetime | None:
    """Run a stream until its input ends; where its watermark stands then, if it has one and moved."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    at = q.lastProgress and q.lastProgress.eventTime.get("watermark")
    return dt.datetime.fromisoformat(at) if at else None


def rows_of(spark: SparkSession, out: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/rows/batch=*")


TAIL_ROW = "run_id string, timestamp long, message string, ts timestamp"


def tail_run_logs(spark: SparkSession, path: str, out: str, page_files: int | None = None) -> DataFrame:
    """SRC-09 / MON-03: the events of the log pages that came since the last call with this ``out``, each once.

    Returns ``run_id``, ``timestamp``, ``message``, ``ts``, ``page`` (number of the
    micro-batch, of ``page_files`` files at most) and ``next_cursor`` (the run's newest timestamp in
    this call, plus one). The cursor is the query's list of files read, in the
    checkpoint, so events with equal or late times are neither lost nor repeated;
    a page that fails is read again as the same page.
    """
    pages: list[int] = []
    sink = batch_sink(out)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        pages.append(batch_id)

    run_to_end(read_run_logs(spark, path, stream=True, page_files=page_files), out, write)
    read = spark.read.schema(f"{TAIL_ROW}, batch long").option("basePath", f"{out}/rows")
    rows = (read.parquet(*[f"{out}/rows/batch={n}" for n in pages]) if pages
            else spark.createDataFrame([], f"{TAIL_ROW}, batch long")).withColumnRenamed("batch", "page")
    newest = rows.groupBy(F.col("run_id").alias("of")).agg((F.max("timestamp") + 1).alias("next_cursor"))
    return rows.join(newest, F.col("run_id").eqNullSafe(F.col("of"))).drop("of")


def error_counts_by_day(spark: SparkSession, sf_dir: str, watermark: str = "1 day", out: str | None = None) -> DataFrame:
    """STR-01: per-day counts per run and level with a watermark (update mode).

    State for windows older than the watermark is dropped; each micro-batch
    writes the rows it updated, so the final value per key is the largest count.
    """
    out = out or scratch_path(spark, "str01")
    logs = run_logs_stream(spark, sf_dir).withWatermark("ts", watermark)
    agg = logs.groupBy(F.window("ts", "1 day").alias("w"), "run_id",
                       M.log_level(F.col("message")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    run_to_end(agg.select(F.col("w.start").alias("day_start"), "run_id", "level", "n"), out, batch_sink(out), "update")
    res = rows_of(spark, out, "day_start timestamp, run_id string, level string, n long")
    return res.groupBy("day_start", "run_id", "level").agg(F.max("n").alias("n"))


def first_rows(rows: DataFrame, out: str, keep: dt.timedelta, late: dt.timedelta) -> DataFrame:
    """A stream's first row per ``cache_key``, remembered for ``keep`` of event time; rows over ``late`` behind are dropped.

    ``rows`` has the columns of ``FIRST_ROW``. Runs until the input's end; with the
    same ``out``, the next call goes on there.
    """
    spark = rows.sparkSession
    thinned = rows.mapInArrow(first_of_each, FIRST_ROW).withWatermark("ts", f"{int(late.total_seconds())} seconds")
    with state_store(spark):
        run_to_end(thinned.groupBy("cache_key").transformWithState(
            FirstPerKey(keep), FIRST_ROW, "append", "EventTime"), out, batch_sink(out))
    return rows_of(spark, out, FIRST_ROW)


def first_per_key(spark: SparkSession, sf_dir: str, keep: dt.timedelta = dt.timedelta(days=1),
                  late: dt.timedelta = dt.timedelta(hours=1), out: str | None = None) -> DataFrame:
    """STR-02: evaluation cache — the first result per cache key, remembered for ``keep`` of event time."""
    e = table_stream(spark, sf_dir, "events", EVENTS_SCHEMA)
    r = e.select(cache_key(), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
                 ((F.col("event_id") % 11).cast("double") / 10).alias("confidence"))
    return first_rows(r, out or scratch_path(spark, "str02"), keep, late)


def change_rows(rows: DataFrame, out: str, delay: dt.timedelta, idle: dt.timedelta, flush: bool = False) -> DataFrame:
    """A stream's changes of status per run, in event time (:class:`~.keyed.StatusChanges`).

    ``rows`` has the columns of ``LOG_ROW``. With ``flush``, the rows that still
    wait at the input's end are given out, too: a mark ``delay`` after the newest row
    goes into a folder that is part of the stream and moves the watermark on.
    """
    spark = rows.sparkSession
    marks = f"{out}/marks"
    spark.createDataFrame([], LOG_ROW).write.mode("append").parquet(marks)
    seconds = f"{int(delay.total_seconds() * 1000)} milliseconds"

    def run() -> dt.datetime | None:
        both = rows.select("event_id", "ts", "run_id", "status").unionByName(
            spark.readStream.schema(LOG_ROW).parquet(marks)).withWatermark("ts", seconds)
        with state_store(spark):
            return run_to_end(both.groupBy("run_id").transformWithStateInPandas(
                StatusChanges(idle), CHANGE_ROW, "append", "EventTime"), out, batch_sink(out))

    watermark = run()
    if flush and watermark:
        # the newest row is ``delay`` after the watermark; timers count whole milliseconds
        beyond = F.lit(watermark.isoformat()).cast("timestamp") + F.lit(2 * delay + dt.timedelta(milliseconds=1))
        mark = spark.range(1).select(F.lit(MARK).cast("long").alias("event_id"), beyond.alias("ts"),
                                     F.lit(None).cast("string").alias("run_id"), F.lit("").alias("status"))
        mark.write.mode("append").parquet(marks)
        run()
    return rows_of(spark, out, CHANGE_ROW)


def status_changes(spark: SparkSession, sf_dir: str, delay: dt.timedelta = dt.timedelta(minutes=10),
                   idle: dt.timedelta = dt.timedelta(days=30), out: str | None = None) -> DataFrame:
    """STR-03: status changes per run; the rows that still wait at the end of the input are given out last."""
    logs = run_logs_stream(spark, sf_dir).select("event_id", "ts", "run_id", "status")
    return change_rows(logs, out or scratch_path(spark, "str03"), delay, idle, flush=True)


def scored_candidates_stream(spark: SparkSession, sf_dir: str, pairs: DataFrame, out: str | None = None) -> DataFrame:
    """STR-04: candidates arriving as a lineitem stream, joined to the static pair
    table; each micro-batch scores its distinct SQL texts once, no state crosses batches."""
    out = out or scratch_path(spark, "str04")
    li = table_stream(spark, sf_dir, "lineitem", LINEITEM_SCHEMA).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = pairs.select("pair_id", "query", F.col("sql").alias("p_sql"), F.col("reasoning").alias("p_reasoning"))
    j = li.join(p, li.l_orderkey == p.pair_id, "inner")
    sink = batch_sink(out)

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(S.score(batch).select("prompt_id", "cand_id", "sql", "is_valid_strict", "total_reward"), batch_id)

    run_to_end(candidate_columns(j), out, write)
    return rows_of(spark, out, "prompt_id long, cand_id long, sql string, is_valid_strict boolean, total_reward double")
