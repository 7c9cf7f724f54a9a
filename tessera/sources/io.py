"""Sources and sinks (SRC-01..11).

Readers always take an explicit schema (no inference), run in PERMISSIVE mode
with a corrupt-record column, and fill documented defaults with ``coalesce``.
Writers are plain DataFrame writers, so every executor writes its own files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written

CORRUPT = "_corrupt_record"
PAIR_SCHEMA = (f"pair_id long, query string, sql string, reasoning string, metadata map<string,string>, "
               f"difficulty string, domain string, {CORRUPT} string")
REQUEST_SCHEMA = "array<struct<query:string, context:string>>"
LOG_SCHEMA = "run_id string, timestamp long, message string"
ENTITY_SCHEMA = ("struct<business_entities: map<string, struct<description: string, primary_tables: array<string>, "
                 "related_tables: array<string>, key_fields: array<string>, common_queries: array<string>>>, "
                 "table_relationships: map<string, struct<has_many: array<string>, referenced_by: array<string>, "
                 "join_conditions: map<string, string>>>, common_abbreviations: map<string, string>>")
DEFAULT_DIFFICULTY, DEFAULT_DOMAIN = "medium", "general"


def read_pairs(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """SRC-01: JSONL pair files (globs allowed); missing keys take defaults.

    Lines are read as text and parsed with ``from_json``; blank lines are
    skipped and malformed lines land in
    ``_corrupt_record`` (see :func:`split_corrupt`). ``source_file`` records the
    input file; :func:`malformed_lines` gives the lines' numbers.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    lines = reader.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))
    lines = lines.where(F.trim("value") != "")  # blank lines are skipped
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    df = lines.select(F.from_json("value", PAIR_SCHEMA, opts).alias("j"), "source_file").select("j.*", "source_file")
    return df.select(
        "pair_id",
        F.coalesce("query", F.lit("")).alias("query"), F.coalesce("sql", F.lit("")).alias("sql"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
        F.coalesce("difficulty", F.lit(DEFAULT_DIFFICULTY)).alias("difficulty"),
        F.coalesce("domain", F.lit(DEFAULT_DOMAIN)).alias("domain"),
        F.col(CORRUPT), "source_file")


def malformed_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False, folders: bool = False) -> DataFrame:
    """SRC-02: ``source_file``, ``line`` (from 1, blank lines count) and ``raw`` of every line that isn't a pair.

    A task numbers the lines of each split of a file as it reads them and leaves
    one row per split: how many lines it has, and its malformed ones with their
    places. The splits' counts, added up in file order, do the rest. Everything
    comes from one pass, so it doesn't matter how the files were split; a row
    holds at most what one split (``spark.sql.files.maxPartitionBytes``) has. With ``folders``, a
    folder's files are one text, in the order of their names, and lines count from its first file's.
    """
    reader = spark.read.option("recursiveFileLookup", "true") if recursive else spark.read
    lines = reader.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"),
                                      F.col("_metadata.file_block_start").alias("split"),
                                      F.monotonically_increasing_id().alias("place"))
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    broken = (F.trim("value") != "") & F.from_json("value", PAIR_SCHEMA, opts)[CORRUPT].isNotNull()
    lines = lines.withColumn("broken", broken)
    splits = written(lines.groupBy("source_file", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"),
        F.collect_list(F.when(F.col("broken"), F.struct("place", F.col("value").alias("raw")))).alias("broken")), "splits")
    text = F.regexp_extract("source_file", "^(.*)/", 1) if folders else F.col("source_file")
    before = Window.partitionBy(text).orderBy("source_file", "split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("source_file", "first", "broken", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = starts.select("source_file", "first", "before", F.explode("broken").alias("b"))
    return found.select("source_file", (F.col("before") + F.col("b.place") - F.col("first") + 1).alias("line"), "b.raw")


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-02: (good rows, quarantined raw lines with their file)."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw"), "source_file")
    return good, bad


def read_requests(df: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC-03: a JSON payload holding one request object or a list of them ->
    one row per query (context defaults to '')."""
    parsed = F.from_json(F.col(payload), REQUEST_SCHEMA)
    single = F.from_json(F.col(payload), "struct<query:string, context:string>")
    arr = F.when(F.trim(F.col(payload)).startswith("["), parsed).otherwise(F.array(single))
    return (df.select("*", F.posexplode(arr).alias("request_no", "r"))
            .select(*[c for c in df.columns if c != payload], "request_no", F.col("r.query").alias("query"),
                    F.coalesce("r.context", F.lit("")).alias("context")))


def write_jsonl(df: DataFrame, path: str) -> None:
    """SRC-04: one JSON object per line (one file per partition)."""
    df.write.mode("overwrite").json(path)


def append_pairs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SRC-05: concatenation that keeps duplicates and tolerates missing columns."""
    return existing.unionByName(new, allowMissingColumns=True)


def save_processed(split_df: DataFrame, stats: DataFrame, path: str, when: dt.datetime | None = None) -> None:
    """SRC-06: split data partitioned by ``split`` plus a stats table stamped with a time."""
    split_df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    stamp = when or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    stats.withColumn("saved_at", F.lit(stamp)).write.mode("overwrite").parquet(f"{path}/stats")


def load_processed(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """SRC-06: read back; a ``split`` filter prunes partitions (only that folder is listed/read)."""
    df = spark.read.parquet(f"{path}/data")
    return df.where(F.col("split") == split) if split else df


def load_entity_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-08: nested entity-mapping JSON -> flat ``cat_entities``, ``cat_joins``, ``cat_terms``."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", ENTITY_SCHEMA).alias("j"))
    ents = raw.select(F.explode("j.business_entities").alias("entity", "e"))
    roles = []
    for role, field in [("primary_table", "primary_tables"), ("related_table", "related_tables"),
                        ("key_field", "key_fields"), ("common_query", "common_queries")]:
        roles.append(ents.select("entity", F.lit(role).alias("role"), F.explode_outer(f"e.{field}").alias("value")))
    entities = roles[0]
    for r in roles[1:]:
        entities = entities.unionByName(r)
    rel = raw.select(F.explode("j.table_relationships").alias("src", "r"))
    joins = rel.select("src", F.explode("r.join_conditions").alias("dst", "condition"))
    terms = raw.select(F.explode("j.common_abbreviations").alias("term", "meaning"))
    return {"cat_entities": entities.where(F.col("value").isNotNull()), "cat_joins": joins, "cat_terms": terms}


def read_run_logs(spark: SparkSession, path: str, stream: bool = False, page_files: int | None = None) -> DataFrame:
    """SRC-09: ``(run_id, timestamp ms, message)`` JSON log pages.

    ``stream=True`` takes new files as new pages, at most ``page_files`` of them a
    micro-batch; :func:`tessera.streaming.streams.tail_run_logs` keeps the cursor.
    """
    reader = spark.readStream if stream else spark.read
    if stream and page_files:
        reader = reader.option("maxFilesPerTrigger", page_files)
    df = reader.schema(LOG_SCHEMA).json(path)
    return df.withColumn("ts", F.timestamp_millis("timestamp"))


def log_lines(df: DataFrame, ts: str = "ts", message: str = "message") -> DataFrame:
    """SRC-10: ``[yyyy-MM-dd HH:mm:ss] message`` text lines."""
    return df.select(F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] "),
                              F.col(message)).alias("value"))


def write_log_text(df: DataFrame, path: str, ts: str = "ts", message: str = "message") -> None:
    log_lines(df, ts, message).write.mode("overwrite").text(path)


def write_eval_report(metrics: DataFrame, results: DataFrame, path: str, when: dt.datetime | None = None,
                      partition_by: str | None = "model") -> None:
    """SRC-11: metrics JSON and detail records written together under one stamped report."""
    stamp = when or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    metrics.withColumn("generated_at", F.lit(stamp)).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    w = results.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(f"{path}/results")


METRICS_SCHEMA = ("total long, correct long, valid_syntax long, domain_tables long, with_reasoning long, accuracy double, "
                  "syntax_rate double, domain_rate double, reasoning_rate double, avg_reward double, "
                  "avg_generation_time double, errors long, generated_at timestamp")
RESULTS_SCHEMA = "prompt_id long, cand_id long, model string, is_correct boolean, reward_score double"


def read_eval_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-11: (metrics, detail records) of a written report."""
    return (spark.read.schema(METRICS_SCHEMA).json(f"{path}/metrics"),
            spark.read.schema(RESULTS_SCHEMA).json(f"{path}/results"))
