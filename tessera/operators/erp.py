"""ERP / project-accounting operators over the logical tables.

Each function is a DataFrame -> DataFrame step a Spark user would write. Joins
carry no ``broadcast`` hint unless the side is bounded by construction; the
dimension tables here grow with the data, so AQE decides from runtime sizes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def rounded(c: Column | str, digits: int = 2) -> Column:
    """Half-up rounding as ``floor(x * 10^d + 0.5) / 10^d`` (engine-independent)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = 10 ** digits
    return F.floor(c * scale + 0.5) / scale


def year_range(col: str, year: int) -> Column:
    """``YEAR(col) = year`` as a sargable range (parquet can use min/max stats)."""
    return (F.col(col) >= F.lit(dt.date(year, 1, 1))) & (F.col(col) < F.lit(dt.date(year + 1, 1, 1)))


def month_of(col: str, as_of: dt.date) -> Column:
    """Same calendar month and year as ``as_of`` (as a range predicate)."""
    start = as_of.replace(day=1)
    nxt = (start.replace(year=start.year + 1, month=1) if start.month == 12
           else start.replace(month=start.month + 1))
    return (F.col(col) >= F.lit(start)) & (F.col(col) < F.lit(nxt))


def last_months(col: str, as_of: dt.date, months: int) -> Column:
    """``col >= add_months(as_of, -n) AND col <= as_of``."""
    return (F.col(col) >= F.add_months(F.lit(as_of), -months)) & (F.col(col) <= F.lit(as_of))


def size_band(budget: Column, large: float = 1_000_000, medium: float = 100_000) -> Column:
    return (F.when(budget > large, "Large").when(budget > medium, "Medium").otherwise("Small"))


def status_category(status: Column) -> Column:
    return (F.when(status == "Active", "Open").when(status == "Completed", "Closed")
            .when(status == "On Hold", "Paused").otherwise("Other"))


def timeline_status(start: Column, end: Column, as_of: dt.date) -> Column:
    d = F.lit(as_of)
    return (F.when(end < d, "Completed").when(start > d, "Not Started").otherwise("In Progress"))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den * 100`` when ``den > 0`` else 0 (ANSI-safe)."""
    return F.when(den > 0, num / den * 100).otherwise(F.lit(0.0))


# ----------------------------------------------------------------- joins

def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """SQL ``left_key NOT IN (SELECT right_key FROM right)`` with three-valued logic.

    Scales as a shuffled anti join on the non-null keys. Two one-row probes
    (bounded: ``limit(1)``) reproduce the NULL rules: any NULL on the right
    empties the result, and a NULL left key survives only an empty right side.
    """
    rk = right.select(F.col(right_key).alias("__rk"))
    right_has_null = rk.where(F.col("__rk").isNull()).select(F.lit(1).alias("__p")).limit(1)
    right_any = rk.select(F.lit(1).alias("__p")).limit(1)
    nonnull = (left.where(F.col(left_key).isNotNull())
               .join(rk.where(F.col("__rk").isNotNull()), F.col(left_key) == F.col("__rk"), "left_anti")
               .join(F.broadcast(right_has_null), how="left_anti"))
    nulls = left.where(F.col(left_key).isNull()).join(F.broadcast(right_any), how="left_anti")
    return nonnull.unionByName(nulls)


def resource_allocation(resources: DataFrame, staff: DataFrame, as_of: dt.date) -> DataFrame:
    """Resource allocation summary: assigned, not-yet-ended staff per resource.

    The staff predicates sit in the ON clause of the left join, so resources
    with no current assignment keep a row with zero allocation. Staff is
    pre-aggregated per resource before the join (map-side partial aggregation),
    so the join sees one row per resource regardless of assignment skew.
    """
    current = staff.where((F.col("status") == "Assigned")
                          & (F.col("end_date").isNull() | (F.col("end_date") >= F.lit(as_of))))
    per_res = current.groupBy("resource_code").agg(
        F.countDistinct("project_code").alias("projects_count"),
        F.sum("allocation_percent").alias("total_allocation"))
    j = resources.join(per_res, "resource_code", "left")
    return j.select(
        "resource_code", "resource_name", "resource_type",
        F.coalesce("projects_count", F.lit(0)).alias("projects_count"),
        "total_allocation", "capacity",
        (F.col("capacity") - F.coalesce("total_allocation", F.lit(0.0))).alias("available_capacity"))


def active_projects(projects: DataFrame, contracts: DataFrame, companies: DataFrame) -> DataFrame:
    """Active projects with their contract's company and profit (two left joins)."""
    p = projects.where(F.col("status") == "Active")
    ct = contracts.select("project_code", "company_code")
    c = companies.select("company_code", "company_name")
    j = p.join(ct, "project_code", "left").join(c, "company_code", "left")
    return j.select("project_code", "project_name", "company_name", "company_code", "budget",
                    "actual_cost", "revenue", (F.col("revenue") - F.col("actual_cost")).alias("profit"),
                    "start_date", "end_date", "status")


def financial_summary(projects: DataFrame, contracts: DataFrame, staff: DataFrame,
                      pre_aggregated: bool = True) -> DataFrame:
    """Project financial summary.

    ``pre_aggregated=False`` reproduces the view as written: contracts and staff
    are both joined before the SUM, so staff cost is multiplied by the number of
    contracts of the project (fan-out). ``pre_aggregated=True`` (default)
    aggregates staff per project first and then joins, which is both correct and
    cheaper (one row per project reaches the join).
    """
    p = projects.select("project_code", "project_name", "budget", "actual_cost", "revenue")
    ct = contracts.select("project_code", "contract_value")
    s = staff.select("project_code", "staff_id", "allocation_percent", "cost_rate")
    keys = ["project_code", "project_name", "budget", "actual_cost", "revenue", "contract_value"]
    if pre_aggregated:
        per_proj = s.groupBy("project_code").agg(
            F.countDistinct("staff_id").alias("staff_count"),
            F.sum(F.col("allocation_percent") * F.col("cost_rate")).alias("total_staff_cost"))
        base = (p.join(ct, "project_code", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
                .join(per_proj, "project_code", "left"))
        out = base.select(*keys, F.coalesce("staff_count", F.lit(0)).alias("staff_count"),
                          "total_staff_cost")
    else:
        j = p.join(ct, "project_code", "left").join(s, "project_code", "left")
        out = j.groupBy(*keys).agg(
            F.countDistinct("staff_id").alias("staff_count"),
            F.sum(F.col("allocation_percent") * F.col("cost_rate")).alias("total_staff_cost"))
    return out.select(*keys, "staff_count", rounded("total_staff_cost").alias("total_staff_cost"),
                      (F.col("budget") - F.col("actual_cost")).alias("budget_variance"),
                      rounded(safe_ratio(F.col("actual_cost"), F.col("budget")), 4)
                      .alias("budget_utilization_percent"))


def hierarchy(projects: DataFrame, max_depth: int = 5, id_col: str = "project_id",
              parent_col: str = "parent_id") -> DataFrame:
    """Where every row's chain of parents leads, at any depth.

    ``(id, root_id, depth, outcome, within_limit)``: ``reached`` (``root_id`` is the
    row without parent at the chain's end, ``depth`` counts the chain's rows),
    ``missing parent`` (the chain names a row that isn't there) or ``cycle`` (it
    leads into one); root_id and depth are null for the last two. ``within_limit``
    says whether a root was reached within ``max_depth`` rows.

    Pointer doubling: a row keeps the furthest ancestor found so far, and a round
    joins it to that ancestor's own furthest one, so a chain of length d takes
    log2(d) joins. A round that settles no row proves that the rest never ends:
    of chains that do end, those twice as long as the last ones settle next.
    Each round's narrow table is written. Of rows that share an id, the smallest
    parent counts; a row without id has a chain of its own but is nobody's parent.
    """
    root = F.col("up").isNull()
    state = projects.groupBy(F.col(id_col).alias("id")).agg(F.min(parent_col).alias("up")).select(
        "id", "up", F.when(root, F.col("id")).alias("root_id"), F.lit(1).cast("long").alias("steps"),
        F.when(root, "reached").alias("outcome"))
    state = written(state, "hierarchy")
    open_rows = state.where("outcome IS NULL").count()
    while open_rows:
        far = state.select(F.col("id").alias("far_id"), F.col("up").alias("far_up"), F.col("root_id").alias("far_root"),
                           F.col("steps").alias("far_steps"), F.col("outcome").alias("far_outcome"))
        j = state.where("outcome IS NULL").join(far, F.col("up") == F.col("far_id"), "left")
        moved = j.select("id", F.col("far_up").alias("up"), F.col("far_root").alias("root_id"),
                         (F.col("steps") + F.col("far_steps")).alias("steps"),
                         F.when(F.col("far_id").isNull(), "missing parent").otherwise(F.col("far_outcome")).alias("outcome"))
        state = written(state.where("outcome IS NOT NULL").unionByName(moved), "hierarchy")
        before, open_rows = open_rows, state.where("outcome IS NULL").count()
        if open_rows == before:
            break
    depth = F.when(F.col("outcome") == "reached", F.col("steps"))
    return state.select(F.col("id").alias(id_col), "root_id", depth.alias("depth"),
                        F.coalesce("outcome", F.lit("cycle")).alias("outcome"),
                        F.coalesce(depth <= max_depth, F.lit(False)).alias("within_limit"))


def with_department_average(projects: DataFrame) -> DataFrame:
    """Attach each project's department-average budget without a window.

    groupBy does partial (map-side) aggregation, so a department holding a
    third of all rows costs no more than any other; the per-department result
    has one row per department and is joined back.
    """
    avg = projects.groupBy("department").agg(F.avg("budget").alias("dept_avg_budget"))
    return projects.join(avg, "department", "inner")


def update_where(df: DataFrame, cond: Column, assignments: dict[str, Column]) -> DataFrame:
    """``UPDATE df SET k = v WHERE cond`` as a new table version (NULL cond = no change)."""
    hit = F.coalesce(cond, F.lit(False))
    cols = [F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c)
            for c in df.columns]
    return df.select(*cols)


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """``DELETE FROM df WHERE cond``: rows whose predicate is NULL are kept."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def insert_values(df: DataFrame, rows: list[dict]) -> DataFrame:
    """``INSERT INTO df VALUES ...`` — appends literal rows with df's schema."""
    new = df.sparkSession.createDataFrame(rows, schema=df.schema)
    return df.unionByName(new)


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """``ORDER BY ... LIMIT n`` -> TakeOrderedAndProject (per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def nth_assignment(staff: DataFrame) -> DataFrame:
    """n-th assignment per resource by start date (row_number with full tie-break)."""
    from .ordered import dense_rank_within, nth_within
    tiebreak = ["start_date", "staff_id", "project_code", "role", "allocation_percent",
                "bill_rate", "cost_rate", "status", "end_date"]
    s = nth_within(staff, ["resource_code"], "start_date", tiebreak, out="assignment_no")
    return dense_rank_within(s, ["resource_code"], "start_date", out="start_rank")


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"dt", "Window"}]
