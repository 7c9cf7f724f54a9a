"""Exact duplicate detection by progressive refinement, in DataFrame functions only.

Rows are grouped by length, then by the hash of a prefix, and only rows whose
group still holds another row have their full text hashed. The first two steps
work on a narrow table (id, length, prefix hash); a text is hashed where it is
read and never moved unless the surviving ids outgrow a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, written

PREFIX = 256  # characters hashed in the second step


def exact_duplicates(docs: DataFrame, prefix: int = PREFIX, carry: dict[str, Column] | None = None) -> DataFrame:
    """Groups of rows with identical texts.

    Returns one row per row of ``docs``: ``doc_id``, ``keep_id`` (largest doc_id
    among equal texts), ``group_size`` (rows with this text) and ``kept``
    (``doc_id = keep_id``), and the columns of ``carry``, given as expressions
    over doc_id and text.

    A null text counts as empty, and empty texts are equal to each other. A null
    doc_id counts as smaller than any other: its row stays only where no row of
    its group has an id, and then keep_id is null. Repeated rows (same id and
    text) are members of one group and share the result. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = id_text(docs)
    names = list(carry or {})
    more = [c.alias(n) for n, c in (carry or {}).items()]
    narrow = written(rows.select("doc_id", F.octet_length("text").alias("size"),
                                 F.xxhash64(F.substring("text", 1, prefix)).alias("prefix_hash"), *more), "lengths")
    # one row per length and prefix hash, counted before it moves; a length that stands alone ends there
    starts = narrow.groupBy("size", "prefix_hash").agg(F.count("*").alias("n"))
    lengths = starts.groupBy("size").agg(F.sum("n").alias("same_length")).where("same_length > 1").select("size")
    shared = starts.join(lengths, "size", "left_semi").where("n > 1").select("size", "prefix_hash")
    # nothing after this join needs the rows of a group together, so AQE can split a hot one
    left = written(narrow.join(shared, ["size", "prefix_hash"], "left_semi").select("doc_id").distinct(), "survivors")
    here = F.col("doc_id").eqNullSafe(F.col("survivor"))
    ids = left.select(F.col("doc_id").alias("survivor"))
    full = written(rows.join(ids, here, "left_semi").select("doc_id", F.sha2("text", 256).alias("full_hash"),
                                                                *more), "hashes")
    groups = written(full.groupBy("full_hash").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
                     "groups")
    several = full.join(groups, "full_hash").select("doc_id", "keep_id", "group_size", *names)
    single = narrow.join(ids, here, "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"),
                                                        F.lit(1).cast("long").alias("group_size"), *names)
    return several.unionByName(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
