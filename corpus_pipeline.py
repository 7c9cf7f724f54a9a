"""Corpus pipeline: raw documents to packed training sequences.

Quality classifier, exact deduplication, near-duplicate removal, secret
redaction, packing. Every stage takes ``(spark, docs, sf_dir)``; all but the last
return the columns of ``documents``. Texts that are null stay null where they are
kept; an empty table passes through every stage.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.llm.common import documents, text_hash, without_repeated_rows, without_rows, written  # noqa: E402
from tessera.llm.exact_dedup import exact_duplicates  # noqa: E402
from tessera.llm.near_dedup import near_duplicates  # noqa: E402
from tessera.llm.packing import packed_sequences  # noqa: E402
from tessera.llm.quality import accepted, held_out, learned  # noqa: E402
from tessera.llm.secret_scan import without_secrets  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ranking rejects; it never learns from held-out labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return accepted(docs, learned(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the one with the largest doc_id; of repeated rows, one."""
    found = exact_duplicates(docs, carry={"text_hash": text_hash()})
    return without_repeated_rows(without_rows(docs, found.where(~F.col("kept"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), keep the smallest doc_id."""
    return without_rows(docs, near_duplicates(docs, words=5, percent=80).where(~F.col("kept")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; no document is dropped."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, with the ids."""
    return packed_sequences(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: The ranking, the secret spans and the ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
