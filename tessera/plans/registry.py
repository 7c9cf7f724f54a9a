"""Registry of runnable queries: one Spark builder + optional DuckDB oracle each.

Plan modules decorate builders with :func:`query`; ``__spark_entry__`` exposes
the registry through ``queries()`` / ``oracle_sql()``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Views
from .oracle_views import with_views

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Entry] = {}

def views(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register ``fn(v: Views) -> DataFrame`` (or ``fn(spark, sf_dir)`` if raw)."""

    def deco(fn):
        if raw:
            build = fn
        else:
            def build(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
                return _fn(views(spark, sf_dir))
            build.__name__ = fn.__name__
            build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query id {name}")
        REGISTRY[name] = Entry(name, build, with_views(sql) if sql else None)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Import for side effects: each module registers its queries.
    from . import erp_queries, quality_queries, text_queries, scoring_queries  # noqa: F401
    from . import linking_queries, corpus_queries, eval_queries, monitor_queries, prompt_queries  # noqa: F401
    from . import source_queries  # noqa: F401
    return REGISTRY
