"""Driver tables: one parquet file per table under an ``sf_dir``.

Reads are lazy; Catalyst prunes columns and pushes filters into the parquet
scan, so callers select only what they need.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Lazy handle on the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.read("supplier")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.read("conversations")

    def register_views(self) -> None:
        for name in TABLE_NAMES:
            self.read(name).createOrReplaceTempView(name)
