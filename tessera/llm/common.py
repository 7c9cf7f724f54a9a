"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path, written  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows and bytes in an Arrow batch: a row is a whole text, so the usual ten thousand would hold too much at once.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; from here on, its session hands texts to Python in batches bounded by rows and by bytes."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns every operator reads; a null text counts as empty."""
    docs = in_small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_crc(col: Column) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def text_hash():
    """Tells apart the texts of rows that share an id; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose (doc_id, text_hash) isn't in ``gone``; null matches null."""
    gone = written(gone.select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct(), "dropped")
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_hash"])
    return docs.join(gone, same, "left_anti")


def without_repeated_rows(docs: DataFrame) -> DataFrame:
    """One of the rows of ``docs`` that share id and text; only rows of ids that repeat are moved."""
    again = written(docs.groupBy("doc_id").count().where("count > 1")
                    .select(F.col("doc_id").alias("_again")), "repeated")
    if again.isEmpty():
        return docs
    same = docs["doc_id"].eqNullSafe(again["_again"])
    several = docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(again, same, "left_anti").unionByName(several)


def slices(texts: Iterator[str], chars: int) -> Iterator[list[str]]:
    """Lists of consecutive texts of about ``chars`` characters each; a longer text stands alone.

    Between two slices, Arrow's pool returns what the last one used: a worker lives
    on through many tasks and stages.
    """
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
            pa.default_memory_pool().release_unused()
        held.append(text)
        size += len(text)
    if held:
        yield held


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at single spaces: the first word of each text, each word's number, and the distinct words."""
    words = pc.split_pattern(pa.array(texts, pa.large_string()), pattern=" ")
    coded = words.flatten().dictionary_encode()
    return (words.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy(zero_copy_only=False),
            coded.dictionary.to_pylist())


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray | slice,
             offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit ids of all words in text order, and where each text's begin; word w's are flat[start[w]:start[w] + size[w]]."""
    count = size[place]
    end = np.cumsum(count, dtype=np.int32)  # a slice of texts has far fewer ids than 32 bits count
    at = np.repeat(start[place].astype(np.int32) - (end - count), count)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at], np.concatenate([[0], end])[offsets]


def joined_ids(ids: list[bytes], place: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`gathered` for the distinct words' ids as bytes."""
    size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
    return gathered(np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size, dtype=np.int32) - size, size, place, offsets)
