"""The operators applied to whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .conversation_repair import damaged, repair_digests
from .conversation_trie import conversation_trie
from .exact_dedup import exact_duplicates
from .fingerprints import fingerprints
from .license_scan import license_digests
from .mixing import mixture
from .near_dedup import near_duplicates
from .packing import packed_sequences
from .pii import personal_digests
from .quality import quality_scores
from .secret_scan import secret_digests
from .sentencepiece_codec import piece_digests
from .token_files import token_digests
from .twins import MIXING, REPAIR, TRIE


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85).drop("text_hash")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), spark)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digests(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(documents(spark, sf_dir), carry={"text_sha256": F.sha2("text", 256)})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_sequences(documents(spark, sf_dir), with_ids=False).drop("ids")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {f.__name__: f for f in (
    op1_quality_ranking, op2_near_duplicates, op3_secret_scan, op4_license_scan, op5_token_files, op6_personal_data,
    op7_sentencepiece, op8_fingerprints, op9_exact_duplicates, op10_packing, op11_mixing, op12_conversation_trie,
    op13_conversation_repair)}

ORACLE_SQL = {
    "op2_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]) END) AS sh
  FROM w
), n AS (
  SELECT w.doc_id, coalesce(c.n, 0) AS n FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY 1) c USING (doc_id)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = n.doc_id
""",
    "op9_exact_duplicates": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
""",
    "op11_mixing": MIXING,
    "op12_conversation_trie": TRIE,
    "op13_conversation_repair": REPAIR,
}
