"""A table in versions: every change writes a new version beside the old ones.

``<path>/data/<name>`` holds a version's rows and ``<path>/manifest`` one small JSON
file per version. A version exists once its manifest line is there; that file is
moved into place as the last step, so a write that fails leaves the table as it was,
and readers of older versions aren't disturbed. Of two writers that made the same
version, the one whose data folder sorts first wins and the other is told.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import erp

MANIFEST = "version long, operation string, folder string, schema string"


class Conflict(RuntimeError):
    """Another writer made this version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, df: DataFrame, path: str) -> VersionedTable:
        """A new table whose version 0 has the rows of ``df``."""
        table = cls(df.sparkSession, path)
        table.spark.createDataFrame([], MANIFEST).write.mode("errorifexists").json(f"{table.path}/manifest")
        table._commit(df, "create", 0)
        return table

    def history(self) -> DataFrame:
        """One row per version: ``version``, ``operation``, ``folder`` and ``schema``."""
        lines = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        first = lines.groupBy("version").agg(F.min(F.struct("folder", "operation", "schema")).alias("m"))
        return first.select("version", "m.operation", "m.folder", "m.schema")

    def version(self) -> int:
        return self.history().agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless given. What is read stays the same while others write."""
        wanted = self.version() if version is None else version
        line = self.history().where(F.col("version") == wanted).first()
        if line is None:
            raise ValueError(f"{self.path} has no version {wanted}")
        return self.spark.read.schema(line.schema).parquet(f"{self.path}/data/{line.folder}")

    def overwrite(self, df: DataFrame, operation: str = "overwrite") -> int:
        """Make ``df`` the next version and return its number."""
        return self._commit(df, operation, self.version() + 1)

    def _commit(self, df: DataFrame, operation: str, version: int) -> int:
        folder = f"{version:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/data/{folder}")
        line = [(version, operation, folder, _ddl(df))]
        self.spark.createDataFrame(line, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        won = self.history().where(F.col("version") == version).first()
        if won.folder != folder:
            raise Conflict(f"version {version} of {self.path} was made by another writer")
        return version

    def update(self, cond: Column, assignments: dict[str, Column]) -> int:
        """DML-01: ``UPDATE ... SET ... WHERE`` as the next version; a null condition changes nothing."""
        return self.overwrite(erp.update_where(self.read(), cond, assignments), "update")

    def insert(self, rows: list[dict]) -> int:
        """DML-02: ``INSERT ... VALUES`` as the next version."""
        return self.overwrite(erp.insert_values(self.read(), rows), "insert")

    def delete(self, cond: Column) -> int:
        """DML-03: ``DELETE ... WHERE`` as the next version; rows whose condition is null stay."""
        return self.overwrite(erp.delete_where(self.read(), cond), "delete")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
