"""COR-08..25 over the pair / candidate tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import corpus as C
from . import sqltext_sql as X
from .registry import query
from .sqltext_sql import q

H = "md5(concat_ws('|', CAST(pair_id AS VARCHAR), '42'))"  # fixed: seeded hash of the key (seed 42)
_CX = X.sql_features("sql")["complexity"]
DIFF = f"(CASE WHEN {_CX} < 3 THEN 'easy' WHEN {_CX} < 6 THEN 'medium' ELSE 'hard' END)"


def _pairs_d(v):
    return v.pairs.withColumn("difficulty", C.difficulty_label(F.col("sql")))


_PD = f"pd AS (SELECT *, {DIFF} AS difficulty FROM pairs)"


@query("cor_08", " UNION ALL ".join(
    [f"SELECT '{n}' AS pattern, sum(CASE WHEN contains(upper(sql), '{p}') THEN 1 ELSE 0 END) AS n FROM pairs"
     for n, p in C.PATTERNS]
    + ["SELECT 'SUBQUERY', sum(CASE WHEN len(regexp_extract_all(upper(sql), 'SELECT', 0)) > 1 THEN 1 ELSE 0 END) FROM pairs"]))
def cor_08(v):
    return C.pattern_coverage(v.pairs)


_NONE = " AND ".join(f"NOT contains(upper(sql), '{t}')" for t in P.DOMAIN_TABLES)


@query("cor_09", " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, sum(CASE WHEN contains(upper(sql), '{t}') THEN 1 ELSE 0 END) AS n FROM pairs"
     for t in P.DOMAIN_TABLES]
    + [f"SELECT 'generic', sum(CASE WHEN {_NONE} THEN 1 ELSE 0 END) FROM pairs"]))
def cor_09(v):
    return C.table_coverage(v.pairs, P.DOMAIN_TABLES)


@query("cor_10", f"""WITH {_PD}
SELECT 'total' AS metric, 'all' AS key, CAST(count(*) AS DOUBLE) AS value FROM pd
UNION ALL SELECT 'domain', domain, CAST(count(*) AS DOUBLE) FROM pd GROUP BY domain
UNION ALL SELECT 'difficulty', difficulty, CAST(count(*) AS DOUBLE) FROM pd GROUP BY difficulty
UNION ALL SELECT 'mean_length', 'query', avg(length(query)) FROM pd
UNION ALL SELECT 'mean_length', 'sql', avg(length(sql)) FROM pd""")
def cor_10(v):
    return C.dataset_stats(_pairs_d(v))


@query("cor_11", """SELECT CAST(floor(length(sql) / 20) * 20 AS INTEGER) AS bucket_start, count(*) AS n FROM pairs
GROUP BY 1""")
def cor_11(v):
    return C.length_histogram(v.pairs, "sql", 20)


_SPLIT = f"""s0 AS (SELECT *, {H} AS h FROM pairs),
s1 AS (SELECT *, row_number() OVER (ORDER BY h, pair_id) AS rn, count(*) OVER () AS n FROM s0),
split AS (SELECT * EXCLUDE (h, rn, n), CASE WHEN rn <= n - floor(n * 0.1) - floor(n * 0.1) THEN 'train'
  WHEN rn <= n - floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM s1)"""


@query("cor_12", f"WITH {_SPLIT} SELECT pair_id, split FROM split")
def cor_12(v):
    return C.split_exact(v.pairs).select("pair_id", "split")


@query("cor_13", f"""SELECT pair_id, CASE WHEN CAST(('0x' || substr({H}, 1, 8)) AS BIGINT) % 100 < 10 THEN 'val'
WHEN CAST(('0x' || substr({H}, 1, 8)) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM pairs""")
def cor_13(v):
    return C.split_hashed(v.pairs).select("pair_id", "split")


@query("cor_14", """SELECT pair_id, replace(replace(query, 'Show', 'List'), 'Find', 'Get') AS query, '{"augmented":"true","type":"paraphrase"}' AS metadata
FROM pairs WHERE contains(lower(query), 'project')""")
def cor_14(v):
    return C.augment_paraphrase(v.pairs).select("pair_id", "query", F.to_json("metadata").alias("metadata"))


_LIMIT_SQL = ("regexp_replace(sql, ';+$', '', 'g') || ' LIMIT 100;'")


_MARKS = {k: '{"augmented":"true","type":"%s"}' % k for k in ("paraphrase", "limit_added")}


@query("cor_15", f"""SELECT pair_id, {_LIMIT_SQL} AS sql, query || ' (limit to 100 results)' AS query,
coalesce(reasoning, '') || chr(10) || 'Added LIMIT for performance.' AS reasoning, '{_MARKS["limit_added"]}' AS metadata
FROM pairs WHERE NOT contains(sql, 'LIMIT')""")
def cor_15(v):
    return C.augment_limit(v.pairs).select("pair_id", "sql", "query", "reasoning", F.to_json("metadata").alias("metadata"))


@query("cor_16", f"""WITH {_SPLIT},
first AS (SELECT * FROM split WHERE split = 'train')
SELECT pair_id, split, NULL AS metadata, query, sql FROM split
UNION ALL SELECT pair_id, split, '{_MARKS["paraphrase"]}', replace(replace(query, 'Show', 'List'), 'Find', 'Get'), sql FROM first
  WHERE contains(lower(query), 'project')
UNION ALL SELECT pair_id, split, '{_MARKS["limit_added"]}', query || ' (limit to 100 results)', {_LIMIT_SQL} FROM first
  WHERE NOT contains(sql, 'LIMIT')""")
def cor_16(v):
    d = C.augment_train(C.split_exact(v.pairs))
    return d.select("pair_id", "split", F.to_json("metadata").alias("metadata"), "query", "sql")


@query("cor_17", f"SELECT pair_id FROM pairs ORDER BY {H}, pair_id LIMIT 32")
def cor_17(v):
    return C.sample_batch(v.pairs, 32).select("pair_id")


@query("cor_18", f"""WITH cats AS (SELECT domain, row_number() OVER (ORDER BY domain) - 1 AS ci, count(*) OVER () AS n
  FROM (SELECT DISTINCT domain FROM pairs)),
r AS (SELECT pair_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {H}, pair_id) AS rn FROM pairs)
SELECT r.pair_id, r.domain FROM r JOIN cats ON r.domain = cats.domain
WHERE r.rn <= floor(32 / cats.n) + CASE WHEN cats.ci < 32 % cats.n THEN 1 ELSE 0 END""")
def cor_18(v):
    return C.sample_balanced(v.pairs, 32, "domain").select("pair_id", "domain")


@query("cor_19", f"""WITH {_PD}, has AS (SELECT count(*) > 0 AS h FROM pd WHERE difficulty = 'easy')
SELECT pair_id, difficulty FROM (SELECT pd.*, CASE WHEN NOT has.h THEN 0 WHEN difficulty = 'easy' THEN 0
  WHEN difficulty = 'medium' THEN 1 END AS p FROM pd, has) WHERE p IS NOT NULL ORDER BY p, {H}, pair_id LIMIT 32""")
def cor_19(v):
    return C.sample_curriculum(_pairs_d(v), 32, "easy").select("pair_id", "difficulty")


@query("cor_20", f"""WITH {_PD}, c AS (SELECT difficulty, count(*) AS n FROM pd GROUP BY difficulty),
e AS (SELECT epoch, CASE WHEN epoch < 1 THEN 'easy' WHEN epoch < 2 THEN 'medium' ELSE 'hard' END AS level
  FROM range(4) t(epoch))
SELECT CAST(e.epoch AS BIGINT) AS epoch, e.level, coalesce(c.n, 0) AS n_available FROM e LEFT JOIN c ON e.level = c.difficulty""")
def cor_20(v):
    counts = _pairs_d(v).groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))
    epochs = v.spark.range(4).withColumnRenamed("id", "epoch")
    e = epochs.select("epoch", C.curriculum_level(F.col("epoch")).alias("level"))
    return (e.join(counts, e.level == counts.difficulty, "left")
            .select("epoch", "level", F.coalesce("n", F.lit(0)).alias("n_available")))


@query("cor_21", """WITH e AS (SELECT p.pair_id, t.epoch FROM pairs p, range(2) t(epoch)),
r AS (SELECT pair_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY
  md5(concat_ws('|', concat_ws('#', CAST(pair_id AS VARCHAR), CAST(epoch AS VARCHAR)), '42')), pair_id) AS position FROM e)
SELECT pair_id, CAST(epoch AS INTEGER) AS epoch, position, CAST(floor((position - 1) / 8) AS BIGINT) AS batch_id FROM r""")
def cor_21(v):
    return C.epoch_batches(v.pairs, 2, 8).select("pair_id", "epoch", "position", "batch_id")


@query("cor_22", f"SELECT pair_id, {DIFF} AS difficulty FROM pairs")
def cor_22(v):
    return v.pairs.select("pair_id", C.difficulty_label(F.col("sql")).alias("difficulty"))


@query("cor_23", "SELECT pair_id, query FROM pairs ORDER BY pair_id LIMIT 5")
def cor_23(v):
    return C.few_shot_select(v.pairs, 5).select("pair_id", "query")


@query("cor_24", """SELECT md5(concat_ws('|', query, sql)) AS cache_key,
min(struct_pack(p := prompt_id, c := cand_id, r := reasoning, e := expected_sql)).p AS prompt_id,
min(struct_pack(p := prompt_id, c := cand_id, r := reasoning, e := expected_sql)).c AS cand_id
FROM candidates GROUP BY md5(concat_ws('|', query, sql))""")
def cor_24(v):
    d = C.cache_dedup(v.candidates.select("prompt_id", "cand_id", "reasoning", "expected_sql", "query", "sql"),
                      ["prompt_id", "cand_id", "reasoning", "expected_sql"])
    return d.select("cache_key", "prompt_id", "cand_id")


_NORM = X.normalize_sql("sql")


@query("cor_25", f"""WITH d AS (SELECT DISTINCT query, {_NORM} AS norm_sql FROM candidates)
SELECT query, count(*) AS n_sql, min(norm_sql) AS min_sql, max(norm_sql) AS max_sql FROM d GROUP BY query HAVING count(*) > 1""")
def cor_25(v):
    return C.conflict_report(v.candidates)


@query("cor_25_shared", f"""WITH d AS (SELECT DISTINCT query, {_NORM} AS norm_sql FROM candidates)
SELECT norm_sql, count(*) AS n_questions FROM d GROUP BY norm_sql HAVING count(*) > 1""")
def cor_25_shared(v):
    return C.shared_sql_report(v.candidates)
