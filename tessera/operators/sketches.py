"""Mergeable sketches: quantiles and distinct counts of fine groups, rolled up without reading the rows again.

A sketch per group is one partial aggregate with a bounded state, so a hot group
costs no more than any other; coarser groups merge the sketches. Exact forms stay
beside them (``ordered`` quantiles, ``countDistinct``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of quantile sketches: a rank is off by less than 0.4 percent of the rows in 99 of 100 cases.
QUANTILE_K = 800
#: Logarithm of the registers of distinct-count sketches: a standard error of 1.6 percent.
DISTINCT_LG_K = 12


def quantile_sketches(df: DataFrame, by: list[str | Column], value: str, k: int = QUANTILE_K) -> DataFrame:
    """One row per group: ``n`` (values that aren't null) and ``sketch`` of ``value``; a group without values has a null sketch."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: list[str | Column], probabilities: dict[str, float],
                     k: int = QUANTILE_K) -> DataFrame:
    """Quantiles of coarser groups from :func:`quantile_sketches`: ``n`` and a column per name, values that occur."""
    merged = sketches.where("sketch IS NOT NULL").groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return merged.select("*", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name)
                                for name, p in probabilities.items()]).drop("sketch")


def distinct_sketches(df: DataFrame, by: list[str | Column], value: str, lg_k: int = DISTINCT_LG_K) -> DataFrame:
    """One row per group: ``sketch`` of the distinct values that aren't null."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: list[str | Column], out: str) -> DataFrame:
    """Estimated distinct counts of coarser groups from :func:`distinct_sketches`."""
    return sketches.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias(out))
