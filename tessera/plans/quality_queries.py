"""DQ-00..13 queries over the ERP fixture views, with DuckDB twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.erp import hierarchy
from .erp_queries import HIERARCHY_SQL
from .registry import query


_STATUS = [("projects", "status"), ("resources", "availability"), ("tickets", "status"), ("contracts", "status")]


def _dom(table: str) -> str:
    return ", ".join(f"'{v}'" for v in Q.STATUS_DOMAIN[table])


@query("dq_01", "SELECT project_code, start_date, end_date FROM projects WHERE end_date < start_date")
def dq_01(v):
    return Q.end_before_start(v.projects).select("project_code", "start_date", "end_date")


@query("dq_02", "SELECT project_code, budget, actual_cost FROM projects WHERE actual_cost > budget")
def dq_02(v):
    return Q.cost_over_budget(v.projects).select("project_code", "budget", "actual_cost")


_DQ03 = [("projects", "project_code"), ("staff", "staff_id"), ("contracts", "contract_number"),
         ("resources", "resource_code"), ("companies", "company_code")]


@query("dq_03", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{k}' AS key_column, CAST({k} AS VARCHAR) AS key_value, count(*) AS n "
    f"FROM {t} GROUP BY {k} HAVING count(*) > 1" for t, k in _DQ03))
def dq_03(v):
    return reduce(DataFrame.unionByName, [Q.duplicate_keys(getattr(v, t), k, t) for t, k in _DQ03])


@query("dq_04", """SELECT r.resource_code, r.capacity, a.allocated FROM resources r
JOIN (SELECT resource_code, SUM(allocation_percent) AS allocated FROM staff WHERE status = 'Assigned' GROUP BY resource_code) a
ON r.resource_code = a.resource_code WHERE a.allocated > r.capacity""")
def dq_04(v):
    return Q.over_capacity(v.resources, v.staff).select("resource_code", "capacity", "allocated")


@query("dq_05", """SELECT s.staff_id, s.resource_code, r.availability FROM staff s JOIN resources r
ON s.resource_code = r.resource_code WHERE s.status = 'Assigned' AND r.availability <> 'Available'""")
def dq_05(v):
    return Q.assigned_unavailable(v.staff, v.resources).select("staff_id", "resource_code", "availability")


@query("dq_06", "SELECT resource_code, cost_rate, billing_rate FROM resources WHERE cost_rate >= billing_rate")
def dq_06(v):
    return Q.cost_not_below_billing(v.resources).select("resource_code", "cost_rate", "billing_rate")


_FKS = [("staff.project_code", "staff", "project_code", "projects", "project_code"),
        ("staff.resource_code", "staff", "resource_code", "resources", "resource_code"),
        ("contracts.project_code", "contracts", "project_code", "projects", "project_code"),
        ("contracts.company_code", "contracts", "company_code", "companies", "company_code"),
        ("contacts.company_id", "contacts", "company_id", "companies", "company_id"),
        ("srm_projects.company_id", "srm_projects", "company_id", "companies", "company_id"),
        ("srm_projects.parent_id", "srm_projects", "parent_id", "srm_projects", "project_id"),
        ("tickets.company_code", "tickets", "company_code", "companies", "company_code"),
        ("revisions.project_code", "revisions", "project_code", "projects", "project_code"),
        ("opportunities.company_id", "opportunities", "company_id", "companies", "company_id")]


@query("dq_07", " UNION ALL ".join(
    f"SELECT '{fk}' AS foreign_key, CAST(c.{ck} AS VARCHAR) AS key_value FROM {ct} c "
    f"WHERE c.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pt} p WHERE p.{pk} = c.{ck})"
    for fk, ct, ck, pt, pk in _FKS))
def dq_07(v):
    return reduce(DataFrame.unionByName, [Q.orphans(getattr(v, ct), ck, getattr(v, pt), pk, fk)
                                          for fk, ct, ck, pt, pk in _FKS])


@query("dq_08", """SELECT ct.contract_number, ct.contract_value, p.budget FROM contracts ct
JOIN projects p ON ct.project_code = p.project_code WHERE abs(ct.contract_value - p.budget) > 0.005""")
def dq_08(v):
    return Q.contract_value_mismatch(v.contracts, v.projects).select("contract_number", "contract_value", "budget")


@query("dq_09", """SELECT ct.contract_number, ct.start_date, ct.end_date FROM contracts ct
JOIN projects p ON ct.project_code = p.project_code
WHERE ct.start_date < p.start_date OR (p.end_date IS NOT NULL AND ct.end_date > p.end_date)""")
def dq_09(v):
    return Q.contract_outside_project(v.contracts, v.projects).select("contract_number", "start_date", "end_date")


@query("dq_10", f"""SELECT 'projects' AS table_name, status AS value, count(*) AS n FROM projects
WHERE NOT coalesce(status IN ({_dom('projects')}), FALSE) GROUP BY status
UNION ALL SELECT 'resources', availability, count(*) FROM resources
WHERE NOT coalesce(availability IN ({_dom('resources')}), FALSE) GROUP BY availability
UNION ALL SELECT 'tickets', status, count(*) FROM tickets
WHERE NOT coalesce(status IN ({_dom('tickets')}), FALSE) GROUP BY status
UNION ALL SELECT 'contracts', status, count(*) FROM contracts
WHERE NOT coalesce(status IN ({_dom('contracts')}), FALSE) GROUP BY status""")
def dq_10(v):
    return reduce(DataFrame.unionByName, [
        Q.status_outside_domain(getattr(v, t), t, c).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(t).alias("table_name"), "value", "n") for t, c in _STATUS])


@query("dq_11", f"""SELECT 'projects.budget' AS rule_column, project_code AS key_value, budget AS value FROM projects
WHERE NOT (budget BETWEEN {Q.BUDGET_MIN} AND {Q.BUDGET_MAX})
UNION ALL SELECT 'resources.capacity', resource_code, capacity FROM resources
WHERE NOT (capacity BETWEEN {Q.CAPACITY_MIN} AND {Q.CAPACITY_MAX})""")
def dq_11(v):
    a = Q.out_of_range(v.projects, "budget", Q.BUDGET_MIN, Q.BUDGET_MAX).select(
        F.lit("projects.budget").alias("rule_column"), F.col("project_code").alias("key_value"), F.col("budget").alias("value"))
    b = Q.out_of_range(v.resources, "capacity", Q.CAPACITY_MIN, Q.CAPACITY_MAX).select(
        F.lit("resources.capacity").alias("rule_column"), F.col("resource_code").alias("key_value"),
        F.col("capacity").alias("value"))
    return a.unionByName(b)


@query("dq_12", f"WITH RECURSIVE {HIERARCHY_SQL} SELECT s.project_id, s.parent_id, "
                "CASE w.outcome WHEN 'reached' THEN 'too deep' ELSE w.outcome END AS outcome, w.depth FROM srm_projects s "
                "JOIN outcomes w ON s.project_id = w.project_id WHERE NOT w.within_limit")
def dq_12(v):
    return Q.too_deep(v.srm_projects).select("project_id", "parent_id", "outcome", "depth")


_NULL_COLS = {"projects": ["project_name", "status", "end_date"], "contacts": ["email", "phone"],
              "resources": ["email"], "staff": ["end_date"]}


@query("dq_13", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS checked, '{c}' AS column_name, "
    f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS null_count FROM {t}"
    for t, cols in _NULL_COLS.items() for c in cols))
def dq_13(v):
    return reduce(DataFrame.unionByName, [Q.null_counts(getattr(v, t), t, cols) for t, cols in _NULL_COLS.items()])


_DEFAULTS = {"contacts": {"email": "unknown", "phone": "unknown"}, "resources": {"email": "unknown"}}


@query("dq_13_fill", """SELECT 'contacts' AS table_name, CAST(contact_id AS VARCHAR) AS key_value, coalesce(email, 'unknown') AS email,
coalesce(phone, 'unknown') AS phone FROM contacts
UNION ALL SELECT 'resources', resource_code, coalesce(email, 'unknown'), NULL FROM resources""")
def dq_13_fill(v):
    """DQ-13: defaults filled in."""
    c = Q.fill_defaults(v.contacts, _DEFAULTS["contacts"])
    r = Q.fill_defaults(v.resources, _DEFAULTS["resources"])
    return c.select(F.lit("contacts").alias("table_name"), F.col("contact_id").cast("string").alias("key_value"), "email", "phone") \
        .unionByName(r.select(F.lit("resources").alias("table_name"), F.col("resource_code").alias("key_value"), "email",
                              F.lit(None).cast("string").alias("phone")))


def _outside(table: str, column: str = "status") -> str:
    return f"NOT coalesce({column} IN ({_dom(table)}), FALSE)"


# rule -> (rows checked, violating rows), as SQL; every rule on all of its tables
_ROLLUP = {
    "DQ-01 projects.end_date": ("projects", "SELECT 1 FROM projects WHERE end_date < start_date"),
    "DQ-02 projects.actual_cost": ("projects", "SELECT 1 FROM projects WHERE actual_cost > budget"),
    **{f"DQ-03 {t}.{k}": (t, f"SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1") for t, k in _DQ03},
    "DQ-04 resources.capacity": ("resources", """SELECT 1 FROM resources r JOIN (SELECT resource_code, SUM(allocation_percent) AS allocated
  FROM staff WHERE status = 'Assigned' GROUP BY resource_code) a ON r.resource_code = a.resource_code WHERE a.allocated > r.capacity"""),
    "DQ-05 staff.resource_code": ("(SELECT * FROM staff WHERE status = 'Assigned')", """SELECT 1 FROM staff s JOIN resources r
  ON s.resource_code = r.resource_code WHERE s.status = 'Assigned' AND r.availability <> 'Available'"""),
    "DQ-06 resources.cost_rate": ("resources", "SELECT 1 FROM resources WHERE cost_rate >= billing_rate"),
    **{f"DQ-07 {fk}": (ct, f"SELECT 1 FROM {ct} c WHERE {ck} IS NOT NULL AND NOT EXISTS "
                           f"(SELECT 1 FROM {pt} p WHERE p.{pk} = c.{ck})") for fk, ct, ck, pt, pk in _FKS},
    "DQ-08 contracts.contract_value": ("contracts", """SELECT 1 FROM contracts ct JOIN projects p ON ct.project_code = p.project_code
  WHERE abs(ct.contract_value - p.budget) > 0.005"""),
    "DQ-09 contracts.start_date": ("contracts", """SELECT 1 FROM contracts ct JOIN projects p ON ct.project_code = p.project_code
  WHERE ct.start_date < p.start_date OR (p.end_date IS NOT NULL AND ct.end_date > p.end_date)"""),
    **{f"DQ-10 {t}.{c}": (t, f"SELECT 1 FROM {t} WHERE {_outside(t, c)}") for t, c in _STATUS},
    "DQ-11 projects.budget": ("projects", f"SELECT 1 FROM projects WHERE NOT (budget BETWEEN {Q.BUDGET_MIN} AND {Q.BUDGET_MAX})"),
    "DQ-11 resources.capacity": ("resources", f"SELECT 1 FROM resources WHERE NOT (capacity BETWEEN {Q.CAPACITY_MIN} AND {Q.CAPACITY_MAX})"),
    "DQ-12 srm_projects.parent_id": ("srm_projects", "SELECT 1 FROM outcomes WHERE NOT within_limit"),
    **{f"DQ-13 {t}.{c}": (t, f"SELECT 1 FROM {t} WHERE {c} IS NULL") for t, cols in _NULL_COLS.items() for c in cols},
}


def _row_rules(table: str) -> dict[str, Column]:
    """The rules that look at one row of a table."""
    rules = {
        "projects": {"DQ-01 projects.end_date": F.col("end_date") < F.col("start_date"),
                     "DQ-02 projects.actual_cost": F.col("actual_cost") > F.col("budget"),
                     "DQ-11 projects.budget": ~F.col("budget").between(Q.BUDGET_MIN, Q.BUDGET_MAX)},
        "resources": {"DQ-06 resources.cost_rate": F.col("cost_rate") >= F.col("billing_rate"),
                      "DQ-11 resources.capacity": ~F.col("capacity").between(Q.CAPACITY_MIN, Q.CAPACITY_MAX)},
    }.get(table, {})
    rules |= {f"DQ-10 {t}.{c}": ~F.coalesce(F.col(c).isin(*Q.STATUS_DOMAIN[t]), F.lit(False))
              for t, c in _STATUS if t == table}
    return rules | {f"DQ-13 {table}.{c}": F.col(c).isNull() for c in _NULL_COLS.get(table, [])}


@query("dq_00", f"WITH RECURSIVE {HIERARCHY_SQL}, counted AS (" + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, (SELECT count(*) FROM {t}) AS checked, (SELECT count(*) FROM ({bad})) AS violations"
    for rule, (t, bad) in _ROLLUP.items()) + """)
SELECT rule, checked, violations, CASE WHEN checked > 0 THEN violations / checked ELSE 0.0 END AS rate FROM counted""")
def dq_00(v):
    """DQ-00: all thirteen rules on all their tables; the row rules of a table in one aggregate."""
    parts = [Q.rule_counts(getattr(v, t), rules) for t in ("projects", "contacts", "tickets") if (rules := _row_rules(t))]
    # a staff row's resource, a resource's staff and a contract's project are looked up once for all their rules
    staff = v.staff.join(v.resources.select("resource_code", "availability").dropDuplicates(["resource_code"]), "resource_code", "left")
    assigned = F.col("status") == "Assigned"
    parts.append(Q.rule_counts(staff, _row_rules("staff") | {
        "DQ-05 staff.resource_code": (assigned, F.col("availability") != "Available")}))
    load = v.staff.where(assigned).groupBy("resource_code").agg(F.sum("allocation_percent").alias("allocated"))
    parts.append(Q.rule_counts(v.resources.join(load, "resource_code", "left"), _row_rules("resources") | {
        "DQ-04 resources.capacity": F.col("allocated") > F.col("capacity")}))
    project = v.projects.select("project_code", "budget", F.col("start_date").alias("p_start"), F.col("end_date").alias("p_end")).dropDuplicates(["project_code"])
    parts.append(Q.rule_counts(v.contracts.join(project, "project_code", "left"), _row_rules("contracts") | {
        "DQ-08 contracts.contract_value": F.abs(F.col("contract_value") - F.col("budget")) > Q.MONEY_TOLERANCE,
        "DQ-09 contracts.start_date": (F.col("start_date") < F.col("p_start")) | (F.col("end_date") > F.col("p_end"))}))
    parts += [Q.key_count(getattr(v, t), k, f"DQ-03 {t}.{k}") for t, k in _DQ03]
    for table in dict.fromkeys(ct for _, ct, *_ in _FKS):
        parts.append(Q.reference_counts(getattr(v, table), {
            f"DQ-07 {fk}": (ck, getattr(v, pt), pk) for fk, ct, ck, pt, pk in _FKS if ct == table}))
    parts.append(Q.rule_counts(hierarchy(v.srm_projects, Q.MAX_DEPTH), {"DQ-12 srm_projects.parent_id": ~F.col("within_limit")}))
    return Q.rollup(parts)
