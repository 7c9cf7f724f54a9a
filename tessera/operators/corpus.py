"""Corpus curation over question/SQL pair DataFrames (COR-08..25).

Randomness is replaced by seeded hashing (``md5(key || '|' || seed)``), so
splits and samples are reproducible, identical on every rerun and independent of
partitioning. Global orders use the two-pass helpers in :mod:`.ordered`; top-k
per group uses ``row_number() <= k``, which Spark turns into a partial
``WindowGroupLimit`` before the shuffle (a hot category never ships more than k
rows per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext as T
from .ordered import global_row_number, hash_bucket, hash_digits

SEED = 42
PATTERNS = [("SELECT", "SELECT"), ("JOIN", "JOIN"), ("GROUP BY", "GROUP BY"), ("HAVING", "HAVING"),
            ("ORDER BY", "ORDER BY"), ("WHERE", "WHERE")]
NEXT_LEVEL = {"easy": "medium", "medium": "hard", "hard": "hard"}


def seeded_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def pattern_coverage(df: DataFrame, sql: str = "sql") -> DataFrame:
    """COR-08: rows using each SQL construct (one aggregate, then unpivot)."""
    u = F.upper(F.col(sql))
    aggs = [F.sum(F.when(u.contains(p), 1).otherwise(0)).alias(name.replace(" ", "_")) for name, p in PATTERNS]
    sub = F.size(F.regexp_extract_all(u, F.lit("SELECT"), 0)) > 1
    aggs.append(F.sum(F.when(sub, 1).otherwise(0)).alias("SUBQUERY"))
    names = [n.replace(" ", "_") for n, _ in PATTERNS] + ["SUBQUERY"]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{n.replace('_', ' ')}', `{n}`" for n in names)
    return wide.select(F.expr(f"stack({len(names)}, {stack}) AS (pattern, n)"))


def table_coverage(df: DataFrame, tables: list[str], sql: str = "sql") -> DataFrame:
    """COR-09: rows mentioning each table, plus rows mentioning none ('generic')."""
    u = F.upper(F.col(sql))
    flags = [F.when(u.contains(t), 1).otherwise(0).alias(f"t{i}") for i, t in enumerate(tables)]
    d = df.select(*flags)
    none = F.sum(F.when(sum(F.col(f"t{i}") for i in range(len(tables))) == 0, 1).otherwise(0))
    wide = d.agg(*[F.sum(f"t{i}").alias(f"t{i}") for i in range(len(tables))], none.alias("generic"))
    stack = ", ".join([f"'{t}', `t{i}`" for i, t in enumerate(tables)] + ["'generic', `generic`"])
    return wide.select(F.expr(f"stack({len(tables) + 1}, {stack}) AS (table_name, n)"))


def difficulty_label(sql: Column) -> Column:
    """COR-22: easy (<3) / medium (<6) / hard from the complexity score."""
    cx = T.sql_features(sql)["complexity"]
    return F.when(cx < 3, "easy").when(cx < 6, "medium").otherwise("hard")


def dataset_stats(df: DataFrame) -> DataFrame:
    """COR-10: total, counts per domain and difficulty, mean question / SQL length."""
    total = df.agg(F.lit("total").alias("metric"), F.lit("all").alias("key"),
                   F.count(F.lit(1)).cast("double").alias("value"))
    by_domain = df.groupBy("domain").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("domain").alias("metric"), F.col("domain").alias("key"), "value")
    by_diff = df.groupBy("difficulty").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("difficulty").alias("metric"), F.col("difficulty").alias("key"), "value")
    lengths = df.agg(F.avg(F.length("query")).alias("q"), F.avg(F.length("sql")).alias("s"))
    mean_q = lengths.select(F.lit("mean_length").alias("metric"), F.lit("query").alias("key"), F.col("q").alias("value"))
    mean_s = lengths.select(F.lit("mean_length").alias("metric"), F.lit("sql").alias("key"), F.col("s").alias("value"))
    return total.unionByName(by_domain).unionByName(by_diff).unionByName(mean_q).unionByName(mean_s)


def length_histogram(df: DataFrame, col: str = "sql", width: int = 20) -> DataFrame:
    """COR-11: counts of text length in buckets of ``width`` characters."""
    b = (F.floor(F.length(col) / width) * width).cast("int")
    return df.groupBy(b.alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))


def split_exact(df: DataFrame, key: str = "pair_id", val: float = 0.1, test: float = 0.1,
                seed: int = SEED) -> DataFrame:
    """COR-12: seeded shuffle; first n - int(n*val) - int(n*test) rows train, then
    int(n*val) val, rest test. The shuffle position is a two-pass global row
    number over the hash order (no single-partition window)."""
    h = seeded_hash(F.col(key), seed)
    d = df.withColumn("__h", h)
    n = df.agg(F.count(F.lit(1))).scalar()
    n_val = F.floor(n * val)
    n_test = F.floor(n * test)
    n_train = n - n_val - n_test
    ranked = global_row_number(d, ["__h", key], hash_bucket(F.col("__h"), hash_digits(d)), out="__rn")
    split = (F.when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_train + n_val, "val")
             .otherwise("test"))
    return ranked.withColumn("split", split).drop("__h", "__rn")


def split_hashed(df: DataFrame, key: str = "pair_id", val: float = 0.1, test: float = 0.1,
                 seed: int = SEED) -> DataFrame:
    """COR-13: approximate split with no shuffle at all: a hash bucket in [0, 100)."""
    bucket = F.conv(F.substring(seeded_hash(F.col(key), seed), 1, 8), 16, 10).cast("long") % 100
    split = (F.when(bucket < int(round(val * 100)), "val").when(bucket < int(round((val + test) * 100)), "test")
             .otherwise("train"))
    return df.withColumn("split", split)


def _augmented(df: DataFrame, kind: str) -> DataFrame:
    """``metadata`` (kept where there is one) with the marks of an augmented row."""
    marks = F.create_map(F.lit("augmented"), F.lit("true"), F.lit("type"), F.lit(kind))
    if "metadata" not in df.columns:
        return df.withColumn("metadata", marks)
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")),
                        lambda k, _: ~k.isin("augmented", "type"))
    return df.withColumn("metadata", F.map_concat(kept, marks))


def augment_paraphrase(df: DataFrame) -> DataFrame:
    """COR-14: questions mentioning 'project': Show->List, Find->Get."""
    hit = F.lower(F.col("query")).contains("project")
    para = F.replace(F.replace(F.col("query"), F.lit("Show"), F.lit("List")), F.lit("Find"), F.lit("Get"))
    return _augmented(df.where(hit).withColumn("query", para), "paraphrase")


def augment_limit(df: DataFrame) -> DataFrame:
    """COR-15: SQL without LIMIT gets `` LIMIT 100;``; question and reasoning say so."""
    return _augmented(
        df.where(~F.col("sql").contains("LIMIT"))
        .withColumn("sql", F.concat(F.regexp_replace("sql", ";+$", ""), F.lit(" LIMIT 100;")))
        .withColumn("query", F.concat("query", F.lit(" (limit to 100 results)")))
        .withColumn("reasoning", F.concat(F.coalesce("reasoning", F.lit("")), F.lit("\nAdded LIMIT for performance."))),
        "limit_added")


def augment_train(split_df: DataFrame, first_n: int | None = None, key: str = "pair_id", seed: int = SEED) -> DataFrame:
    """COR-16: augment the train rows and append; ``first_n`` takes only so many, in shuffle order."""
    first = split_df.where(F.col("split") == "train")
    if first_n is not None:
        first = first.orderBy(seeded_hash(F.col(key), seed), key).limit(first_n)  # TakeOrdered, bounded
    base = split_df if "metadata" in split_df.columns else split_df.withColumn(
        "metadata", F.lit(None).cast("map<string,string>"))
    return base.unionByName(augment_paraphrase(first)).unionByName(augment_limit(first))


def sample_batch(df: DataFrame, k: int, key: str = "pair_id", seed: int = SEED) -> DataFrame:
    """COR-17: k rows without replacement (all rows when fewer) — seeded TakeOrdered."""
    return df.orderBy(seeded_hash(F.col(key), seed), key).limit(k)


def sample_balanced(df: DataFrame, k: int, by: str, key: str = "pair_id", seed: int = SEED) -> DataFrame:
    """COR-18: k // n rows per category, one extra for the first k % n categories
    (sorted), each capped by what the category has."""
    cats = df.select(by).distinct()
    n = cats.agg(F.count(F.lit(1))).scalar()
    ordinal = cats.withColumn("__ci", F.row_number().over(Window.orderBy(by)) - 1)  # one row per category
    quota = (F.floor(F.lit(k) / n) + F.when(F.col("__ci") < F.lit(k) % n, 1).otherwise(0))
    w = Window.partitionBy(by).orderBy(seeded_hash(F.col(key), seed), key)
    ranked = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)  # group limit pushed down
    return ranked.join(ordinal, by).where(F.col("__rn") <= quota).drop("__rn", "__ci")


def sample_curriculum(df: DataFrame, k: int, level: str, key: str = "pair_id", seed: int = SEED) -> DataFrame:
    """COR-19: k rows of ``level``; a shortfall is filled from the next level; a
    level with no rows falls back to a plain sample."""
    nxt = NEXT_LEVEL[level]
    has_level = df.where(F.col("difficulty") == level).agg(F.count(F.lit(1))).scalar() > 0
    prio = (F.when(~has_level, F.lit(0))
            .when(F.col("difficulty") == level, F.lit(0))
            .when(F.col("difficulty") == nxt, F.lit(1)))
    d = df.withColumn("__p", prio).where(F.col("__p").isNotNull())
    return d.orderBy("__p", seeded_hash(F.col(key), seed), key).limit(k).drop("__p")


def curriculum_level(epoch: Column, enabled: bool = True) -> Column:
    """COR-20: epoch < 1 easy, < 2 medium, else hard; medium when disabled."""
    if not enabled:
        return F.lit("medium")
    return F.when(epoch < 1, "easy").when(epoch < 2, "medium").otherwise("hard")


def epoch_batches(df: DataFrame, epochs: int, size: int, key: str = "pair_id", seed: int = SEED) -> DataFrame:
    """COR-21: per epoch a fresh seeded order, consecutive batches of ``size``.

    Epochs are generated with ``explode(sequence())`` (no join); positions come
    from a two-pass row number bucketed by (epoch, hash prefix).
    """
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    d = d.withColumn("__h", seeded_hash(F.concat_ws("#", F.col(key).cast("string"), F.col("epoch").cast("string")), seed))
    digits = hash_digits(d)
    bucket = F.col("epoch") * 16**digits + hash_bucket(F.col("__h"), digits)
    r = global_row_number(d, ["epoch", "__h", key], bucket, out="__rn")
    # row numbers run across epochs; rebase them per epoch with the epoch sizes
    n = df.agg(F.count(F.lit(1))).scalar()
    pos = F.col("__rn") - F.col("epoch") * n
    return r.withColumn("position", pos).withColumn("batch_id", F.floor((pos - 1) / size).cast("long")).drop("__h", "__rn")


def few_shot_select(df: DataFrame, n: int = 5, key: str = "pair_id") -> DataFrame:
    """COR-23: the first n pairs in stable (key) order — TakeOrdered, bounded."""
    return df.orderBy(key).limit(n)


def cache_dedup(df: DataFrame, order: list[str]) -> DataFrame:
    """COR-24: one row per md5(query || '|' || sql), the first by ``order`` kept.

    ``min(struct(order..., row))`` is a partial aggregate: a hot key is reduced
    map-side instead of being collected into one task.
    """
    k = F.md5(F.concat_ws("|", "query", "sql")).alias("cache_key")
    cols = [c for c in df.columns if c not in order]
    first = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in cols])).alias("__first")
    g = df.groupBy(k).agg(first)
    return g.select("cache_key", *[F.col(f"__first.{c}").alias(c) for c in order + cols])


def conflict_report(df: DataFrame) -> DataFrame:
    """COR-25a: questions answered by more than one distinct (normalised) SQL."""
    d = df.select("query", T.normalize_sql(F.col("sql")).alias("norm_sql")).distinct()
    return (d.groupBy("query").agg(F.count(F.lit(1)).alias("n_sql"), F.min("norm_sql").alias("min_sql"),
                                   F.max("norm_sql").alias("max_sql")).where(F.col("n_sql") > 1))


def shared_sql_report(df: DataFrame) -> DataFrame:
    """COR-25b: normalised SQL texts shared by more than one question."""
    d = df.select("query", T.normalize_sql(F.col("sql")).alias("norm_sql")).distinct()
    return d.groupBy("norm_sql").agg(F.count(F.lit(1)).alias("n_questions")).where(F.col("n_questions") > 1)
