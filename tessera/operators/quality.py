"""ERP data-quality rules (DQ-01..13) and their roll-up (DQ-00).

Each rule returns the violating rows. The roll-up counts checked rows and violations:
:func:`rule_counts` all row rules of a table in one aggregate, rules over a key or
another table by counts per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .erp import hierarchy

# ---- fixed values: allowed status domains for the logical tables ------------
STATUS_DOMAIN = {
    "projects": ["Active", "Inactive", "On Hold", "Completed", "Cancelled"],
    "resources": ["Available", "Busy", "Unavailable"],
    "tickets": ["Open", "In Progress", "Resolved", "Closed"],
    "contracts": ["Active", "Draft", "Expired", "Terminated"],
}
BUDGET_MIN, BUDGET_MAX = 0.0, 999_999_999.99
CAPACITY_MIN, CAPACITY_MAX = 0.0, 100.0
MAX_DEPTH = 5
MONEY_TOLERANCE = 0.005


def end_before_start(projects: DataFrame) -> DataFrame:
    """DQ-01: End_Date >= Start_Date (rows with a NULL end are not violations)."""
    return projects.where(F.col("end_date") < F.col("start_date"))


def cost_over_budget(projects: DataFrame) -> DataFrame:
    """DQ-02: Actual_Cost <= Budget."""
    return projects.where(F.col("actual_cost") > F.col("budget"))


def duplicate_keys(df: DataFrame, key: str, table: str) -> DataFrame:
    """DQ-03: key values that occur more than once (partial aggregation)."""
    return (df.groupBy(F.col(key).cast("string").alias("key_value")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).select(F.lit(table).alias("table_name"), F.lit(key).alias("key_column"),
                                          "key_value", "n"))


def over_capacity(resources: DataFrame, staff: DataFrame) -> DataFrame:
    """DQ-04: sum of assigned allocation per resource exceeds its capacity."""
    alloc = (staff.where(F.col("status") == "Assigned").groupBy("resource_code")
             .agg(F.sum("allocation_percent").alias("allocated")))
    return (resources.select("resource_code", "capacity").join(alloc, "resource_code")
            .where(F.col("allocated") > F.col("capacity")))


def assigned_unavailable(staff: DataFrame, resources: DataFrame) -> DataFrame:
    """DQ-05: an assigned staff row whose resource is not Available."""
    r = resources.select("resource_code", "availability")
    return (staff.where(F.col("status") == "Assigned").join(r, "resource_code")
            .where(F.col("availability") != "Available"))


def cost_not_below_billing(resources: DataFrame) -> DataFrame:
    """DQ-06: Cost_Rate < Billing_Rate."""
    return resources.where(F.col("cost_rate") >= F.col("billing_rate"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, fk: str) -> DataFrame:
    """DQ-07: non-null foreign keys with no parent row (shuffled anti join)."""
    p = parent.select(F.col(parent_key).alias("__pk")).distinct()
    return (child.where(F.col(child_key).isNotNull())
            .join(p, F.col(child_key) == F.col("__pk"), "left_anti")
            .select(F.lit(fk).alias("foreign_key"), F.col(child_key).cast("string").alias("key_value")))


def contract_value_mismatch(contracts: DataFrame, projects: DataFrame) -> DataFrame:
    """DQ-08: contract value differs from the project budget."""
    p = projects.select("project_code", "budget")
    return (contracts.join(p, "project_code")
            .where(F.abs(F.col("contract_value") - F.col("budget")) > MONEY_TOLERANCE))


def contract_outside_project(contracts: DataFrame, projects: DataFrame) -> DataFrame:
    """DQ-09: contract dates must lie inside the project's dates."""
    p = projects.select("project_code", F.col("start_date").alias("p_start"), F.col("end_date").alias("p_end"))
    j = contracts.join(p, "project_code")
    return j.where((F.col("start_date") < F.col("p_start"))
                   | (F.col("p_end").isNotNull() & (F.col("end_date") > F.col("p_end"))))


def status_outside_domain(df: DataFrame, table: str, column: str = "status") -> DataFrame:
    """DQ-10: status value not in the table's allowed domain (NULL is reported too)."""
    allowed = STATUS_DOMAIN[table]
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def out_of_range(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    """DQ-11: value outside [lo, hi]."""
    return df.where(~F.col(column).between(lo, hi))


def too_deep(srm_projects: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """DQ-12: projects not within ``max_depth`` levels of a root, with the reason (deeper
    chains, chains into a cycle and chains that end in a missing parent)."""
    deep = F.when(F.col("outcome") == "reached", "too deep").otherwise(F.col("outcome"))
    bad = hierarchy(srm_projects, max_depth).where(~F.col("within_limit"))
    return srm_projects.join(bad.select("project_id", deep.alias("outcome"), "depth"), "project_id")


def null_counts(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """DQ-13: NULL count per column in one aggregate pass."""
    agg = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return agg.select(F.lit(table).alias("table_name"), F.col("__n").alias("checked"),
                      F.expr(f"stack({len(columns)}, {stack}) AS (column_name, null_count)"))


def fill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """DQ-13: NULLs of the named columns take their defaults; all rows are returned."""
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns])


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``(rule, checked, violations)`` of all row rules of one table, in one aggregate.

    A rule is a condition that violating rows meet; null is no violation. A rule
    may be given as ``(scope, condition)``, and then checks the rows in scope only.
    """
    aggs = []
    for k, rule in enumerate(rules.values()):
        scope, bad = rule if isinstance(rule, tuple) else (F.lit(True), rule)
        aggs += [F.count(F.when(scope, 1)).alias(f"c{k}"), F.count(F.when(scope & bad, 1)).alias(f"v{k}")]
    stack = ", ".join(f"'{name}', c{k}, v{k}" for k, name in enumerate(rules))
    return df.agg(*aggs).select(F.expr(f"stack({len(rules)}, {stack}) AS (rule, checked, violations)"))


def key_count(df: DataFrame, key: str, rule: str) -> DataFrame:
    """DQ-03 as a count: rows and keys that occur more than once; null is a key."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.count(F.when(F.col("n") > 1, 1)).alias("violations")) \
        .select(F.lit(rule).alias("rule"), "checked", "violations")


def reference_counts(child: DataFrame, keys: dict[str, tuple[str, DataFrame, str]]) -> DataFrame:
    """DQ-07 as counts: for all foreign keys of one table, ``{rule: (column, parent, parent key)}``.

    Keys are counted per distinct value first, so a value that many rows share is
    looked up once; one row per rule comes back.
    """
    parts = []
    for rule, (column, parent, parent_key) in keys.items():
        used = child.groupBy(F.col(column).alias("__key")).agg(F.count(F.lit(1)).alias("n"))
        there = parent.select(F.col(parent_key).alias("__there")).distinct()
        j = used.join(there, F.col("__key") == F.col("__there"), "left")
        missing = F.col("__key").isNotNull() & F.col("__there").isNull()
        parts.append(j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
                           F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("violations"))
                     .select(F.lit(rule).alias("rule"), "checked", "violations"))
    return reduce(DataFrame.unionByName, parts)


def rollup(parts: list[DataFrame]) -> DataFrame:
    """DQ-00: ``(rule, checked, violations, rate)`` from counts per rule."""
    out = reduce(DataFrame.unionByName, parts)
    return out.select("rule", "checked", "violations",
                      F.when(F.col("checked") > 0, F.col("violations") / F.col("checked")).otherwise(0.0).alias("rate"))
