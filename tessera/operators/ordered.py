"""Order-dependent operators that avoid a single-partition window.

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task, and
``partitionBy(key)`` sorts a hot key in one task. Global orders here are made by a
range shuffle instead:

1. aggregate to one row per distinct key where the result allows it (map-side
   combine: rows that share a key never meet in one task);
2. range-partition by the key, sort inside the partitions and number the rows
   (partition number and place in it); write that frame once, so that the numbers
   stay the same for everything that follows;
3. add up the partitions' totals (one row per partition) and add each partition's
   start to its own running value.

The plan's size doesn't depend on the number of partitions. Per-key orders over
time (``lag``, running maximum) work in (key, time span) groups and patch each
group with a one-row-per-group summary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

_B = "__bucket"
_PART, _PLACE = "__part", "__place"


def _in_range_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of its range partition and its place in it, written once."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id: the partition number in the upper 31 bits, the row's place in the lower 33
    placed = placed.withColumn(_PLACE, F.monotonically_increasing_id())
    placed = placed.withColumn(_PART, F.shiftright(_PLACE, 33).cast("int"))
    return written(placed.withColumn(_PLACE, F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1))), name)


def in_range_order(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, str, str]:
    """``df`` in range order, written once, and the names of its columns for the range partition and the place in it.

    For running values: take them inside (partition, key) and add what the key has in earlier partitions.
    """
    return _in_range_order(df, order, name), _PART, _PLACE


def _starts(placed: DataFrame, total: Column, out: str) -> DataFrame:
    """What all earlier partitions hold: one row per partition, so it may be broadcast."""
    w = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy(_PART).agg(total.alias("__total"))
    return F.broadcast(per.select(_PART, F.coalesce(F.sum("__total").over(w), F.lit(0)).alias(out)))


def row_positions(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: its 1-based place in the total order."""
    placed = _in_range_order(df, order, "positions")
    return (placed.join(_starts(placed, F.count(F.lit(1)), "__start"), _PART)
            .withColumn(out, F.col("__start") + F.col(_PLACE) + 1).drop(_PART, _PLACE, "__start"))


def sums_before(per_key: DataFrame, order: Column, value: str, out: str) -> DataFrame:
    """One row per key: ``out`` is the sum of ``value`` over all smaller keys."""
    placed = _in_range_order(per_key, [order], "sums")
    w = Window.partitionBy(_PART).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("__inner", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return (inner.join(_starts(placed, F.sum(value), "__start"), _PART)
            .withColumn(out, F.col("__start") + F.col("__inner")).drop(_PART, _PLACE, "__start", "__inner"))


def _join_key(df: DataFrame, keys: DataFrame, names: list[str], *out: Column) -> DataFrame:
    """Join values of distinct keys back; a plain join, so AQE can split a hot key."""
    cond = [df[c].eqNullSafe(keys[c]) for c in names]
    return df.join(keys, cond, "inner").select(df["*"], *out)


def _order(key: str, descending: bool) -> Column:
    return F.col(key).desc() if descending else F.col(key).asc()


def global_rank(df: DataFrame, key: str, descending: bool = False, out: str = "rank", dense: bool = False) -> DataFrame:
    """``RANK()`` / ``DENSE_RANK()`` over ``ORDER BY key [DESC]`` for the whole table."""
    per = df.groupBy(key).agg((F.max(F.lit(1)) if dense else F.count(F.lit(1))).cast("long").alias("__n"))
    ranks = sums_before(per, _order(key, descending), "__n", "__before")
    return _join_key(df, ranks, [key], (ranks["__before"] + 1).cast("int").alias(out))


def global_running_sum(df: DataFrame, key: str, value: str, out: str = "running_total") -> DataFrame:
    """``SUM(value) OVER (ORDER BY key)`` with the default RANGE frame (peers share)."""
    per = df.groupBy(key).agg(F.sum(value).alias("__own"))
    sums = sums_before(per, _order(key, False), "__own", "__before")
    return _join_key(df, sums, [key], (sums["__before"] + sums["__own"]).alias(out))


def hash_digits(df: DataFrame) -> int:
    """Hex digits of a hash that give at least four buckets per shuffle partition."""
    return math.ceil(math.log(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16))


def hash_bucket(hex_hash: Column, digits: int) -> Column:
    """Bucket for an order by a hex hash string: its first ``digits`` digits."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("long")


def global_row_number(df: DataFrame, order: list[str], bucket: Column, out: str = "row_number") -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order...)`` given a bucket monotone in ``order``.

    ``order`` must be a total order (end it with a unique key); ``bucket`` is
    e.g. :func:`hash_bucket` of the leading hash column.
    """
    d = df.withColumn(_B, bucket)
    local = d.withColumn("__local", F.row_number().over(Window.partitionBy(_B).orderBy(*order)))
    w = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(_B).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(_B, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (local.join(starts, _B, "left")
            .withColumn(out, (F.col("__local") + F.col("__off")).cast("long"))
            .drop("__local", "__off", _B))


def nth_within(df: DataFrame, part: list[str], primary: str, tiebreak: list[str],
               out: str = "nth") -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY part ORDER BY primary, tiebreak...)``.

    Rows are numbered in one global order by part, primary and tiebreak; a row's
    number is its distance to the first row of its part. Neither a hot part nor a
    hot (part, primary) value is sorted in one task.
    """
    order = list(dict.fromkeys([*part, primary, *tiebreak]))
    placed = row_positions(df, [F.col(c) for c in order], "__pos")
    first = placed.groupBy(*part).agg(F.min("__pos").alias("__first"))
    cond = [placed[c].eqNullSafe(first[c]) for c in part]
    return (placed.join(first, cond, "inner").select(placed["*"], first["__first"])
            .withColumn(out, (F.col("__pos") - F.col("__first") + 1).cast("int")).drop("__pos", "__first"))


def dense_rank_within(df: DataFrame, part: list[str], order: str, out: str = "dense_rank") -> DataFrame:
    """``DENSE_RANK() OVER (PARTITION BY part ORDER BY order)`` via the distinct keys.

    Ranks are computed on the distinct ``(part, order)`` values only and joined
    back, so a hot partition key never has its rows sorted in one task.
    """
    keys = df.select(*part, order).distinct()
    ranked = keys.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(order)))
    return _join_key(df, ranked, [*part, order], ranked[out].cast("int").alias(out))


def time_span(ts: str, unit: str = "hour") -> Column:
    """A monotone group of a time column: rows of one key are handled per span, not per key."""
    return F.date_trunc(unit, F.col(ts).cast("timestamp"))


def lag_within(df: DataFrame, part: list[str], order: list[str], value: str, out: str, span: Column) -> DataFrame:
    """``LAG(value) OVER (PARTITION BY part ORDER BY order...)`` without sorting a
    whole hot key in one task.

    ``span`` is monotone in the leading order column. ``lag`` runs inside each
    (key, span) group, and a group's first row takes the last value of the key's
    previous group, found on a one-row-per-group summary.
    """
    d = df.withColumn(_B, span)
    w = Window.partitionBy(*part, _B).orderBy(*order)
    d = d.withColumn("__lag", F.lag(value).over(w)).withColumn("__rn", F.row_number().over(w))
    last = d.groupBy(*part, _B).agg(F.max(F.struct(*[F.col(c) for c in order], F.col(value).alias("__v")))
                                    .alias("__last"))
    wb = Window.partitionBy(*part).orderBy(_B)
    last = last.select(*part, _B, F.lag(F.col("__last.__v")).over(wb).alias("__prev"))
    j = d.join(last, [*part, _B], "inner")
    res = F.when(F.col("__rn") == 1, F.col("__prev")).otherwise(F.col("__lag"))
    return j.withColumn(out, res).drop("__lag", "__rn", "__prev", _B)


def running_extreme_before(df: DataFrame, part: list[str], order: list[str], value: str, out: str, span: Column,
                           smallest: bool = False) -> DataFrame:
    """``MAX(value)`` (or ``MIN``) ``OVER (PARTITION BY part ORDER BY order ROWS UNBOUNDED PRECEDING TO 1
    PRECEDING)`` via (key, span) groups plus a prefix extreme over the groups' summary."""
    best, pick = (F.min, F.least) if smallest else (F.max, F.greatest)
    d = df.withColumn(_B, span)
    w = Window.partitionBy(*part, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__inner", best(value).over(w))
    summ = d.groupBy(*part, _B).agg(best(value).alias("__best"))
    wb = Window.partitionBy(*part).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*part, _B, best("__best").over(wb).alias("__before"))
    j = d.join(summ, [*part, _B], "inner")
    return j.withColumn(out, pick(F.col("__inner"), F.col("__before"))).drop("__inner", "__before", _B)  # NULLs ignored
