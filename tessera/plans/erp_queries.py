"""ERP queries (REL / JOIN / AGG / SUB / SET / WIN / SORT / DML / VIEW).

Each entry is the Spark form of a question-class from the corpus, run over the
fixture views at full size, with its DuckDB twin.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import erp, sketches
from ..operators.ordered import global_rank, global_running_sum
from ..sources.fixtures import ERP_AS_OF
from ..sources.versions import VersionedTable
from ..storage import scratch_path
from .registry import query

AS_OF = ERP_AS_OF
D = "DATE '2000-01-01'"  # fixed value: SQL literal of ERP_AS_OF
r2, r4 = erp.rounded, (lambda c: erp.rounded(c, 4))

# ------------------------------------------------------------ REL


@query("rel_01", "SELECT * FROM projects")
def rel_01(v):
    return v.projects


@query("rel_02", "SELECT project_code, project_name, budget FROM projects")
def rel_02(v):
    return v.projects.select("project_code", "project_name", "budget")


@query("rel_03", "SELECT project_code, project_name, department FROM projects WHERE status = 'Active'")
def rel_03(v):
    return v.projects.where(F.col("status") == "Active").select("project_code", "project_name", "department")


@query("rel_04", "SELECT project_code, budget FROM projects WHERE budget > 300000")
def rel_04(v):
    return v.projects.where(F.col("budget") > 300000).select("project_code", "budget")


@query("rel_05", "SELECT project_code, budget, actual_cost FROM projects WHERE actual_cost > budget")
def rel_05(v):
    return v.projects.where(F.col("actual_cost") > F.col("budget")).select("project_code", "budget", "actual_cost")


@query("rel_06", "SELECT project_code, budget FROM projects WHERE budget BETWEEN 100000 AND 200000")
def rel_06(v):
    return v.projects.where(F.col("budget").between(100000, 200000)).select("project_code", "budget")


@query("rel_07", """SELECT project_code, status, department FROM projects
WHERE status IN ('Active', 'On Hold') AND department NOT IN ('5-LOW', '4-NOT SPECIFIED')""")
def rel_07(v):
    p = v.projects
    return p.where(F.col("status").isin("Active", "On Hold")
                   & ~F.col("department").isin("5-LOW", "4-NOT SPECIFIED")).select("project_code", "status", "department")


@query("rel_08", """SELECT project_code, project_name, department FROM projects
WHERE project_name LIKE 'PRJ-1%' AND (project_name LIKE '%7' OR department LIKE '%MED%')""")
def rel_08(v):
    p = v.projects
    return p.where(F.col("project_name").startswith("PRJ-1")
                   & (F.col("project_name").endswith("7") | F.col("department").contains("MED"))
                   ).select("project_code", "project_name", "department")


@query("rel_09", "SELECT contact_id, contact_name, phone FROM contacts WHERE email IS NULL AND phone IS NOT NULL")
def rel_09(v):
    c = v.contacts
    return c.where(F.col("email").isNull() & F.col("phone").isNotNull()).select("contact_id", "contact_name", "phone")


@query("rel_10", """SELECT project_code, status, budget FROM projects
WHERE status != 'Completed' AND budget > 100000 AND department = '1-URGENT'""")
def rel_10(v):
    p = v.projects
    return p.where((F.col("status") != "Completed") & (F.col("budget") > 100000)
                   & (F.col("department") == "1-URGENT")).select("project_code", "status", "budget")


@query("rel_11", "SELECT DISTINCT department, status FROM projects")
def rel_11(v):
    return v.projects.select("department", "status").distinct()


@query("rel_12", """SELECT project_code, actual_cost - budget AS overrun, budget - actual_cost AS variance,
revenue - actual_cost AS profit FROM projects""")
def rel_12(v):
    p = v.projects
    return p.select("project_code", (F.col("actual_cost") - F.col("budget")).alias("overrun"),
                    (F.col("budget") - F.col("actual_cost")).alias("variance"),
                    (F.col("revenue") - F.col("actual_cost")).alias("profit"))


@query("rel_12_rate", """SELECT staff_id, project_code, allocation_percent * bill_rate / 100 AS effective_rate FROM staff""")
def rel_12_rate(v):
    s = v.staff
    return s.select("staff_id", "project_code",
                    (F.col("allocation_percent") * F.col("bill_rate") / 100).alias("effective_rate"))


@query("rel_13", """SELECT project_code, floor((revenue - actual_cost) / revenue * 100 * 10000 + 0.5) / 10000 AS margin_pct
FROM projects WHERE revenue > 0""")
def rel_13(v):
    p = v.projects
    return p.where(F.col("revenue") > 0).select(
        "project_code", r4((F.col("revenue") - F.col("actual_cost")) / F.col("revenue") * 100).alias("margin_pct"))


@query("rel_14", """SELECT project_code, floor(CASE WHEN budget > 0 THEN actual_cost / budget * 100 ELSE 0 END * 10000 + 0.5) / 10000
AS utilization_pct FROM projects""")
def rel_14(v):
    p = v.projects
    return p.select("project_code", r4(erp.safe_ratio(F.col("actual_cost"), F.col("budget"))).alias("utilization_pct"))


@query("rel_15", """SELECT project_code, CASE WHEN budget > 1000000 THEN 'Large' WHEN budget > 100000 THEN 'Medium'
ELSE 'Small' END AS size_band FROM projects""")
def rel_15(v):
    return v.projects.select("project_code", erp.size_band(F.col("budget")).alias("size_band"))


@query("rel_16", """SELECT project_code, CASE status WHEN 'Active' THEN 'Open' WHEN 'Completed' THEN 'Closed'
WHEN 'On Hold' THEN 'Paused' ELSE 'Other' END AS category FROM projects""")
def rel_16(v):
    return v.projects.select("project_code", erp.status_category(F.col("status")).alias("category"))


@query("rel_17", """SELECT contact_id, COALESCE(email, 'no-email') AS email, COALESCE(phone, 'n/a') AS phone,
COALESCE(CASE WHEN contact_id % 3 = 0 THEN NULL ELSE contact_id / 10 END, 0) AS company_ref FROM contacts""")
def rel_17(v):
    c = v.contacts
    ref = F.when(F.col("contact_id") % 3 == 0, F.lit(None)).otherwise(F.col("contact_id") / 10)
    return c.select("contact_id", F.coalesce("email", F.lit("no-email")).alias("email"),
                    F.coalesce("phone", F.lit("n/a")).alias("phone"),
                    F.coalesce(ref, F.lit(0.0)).alias("company_ref"))


@query("rel_18", "SELECT project_code, start_date FROM projects WHERE year(start_date) = year(DATE '2000-01-01')")
def rel_18(v):
    return v.projects.where(erp.year_range("start_date", AS_OF.year)).select("project_code", "start_date")


@query("rel_19", f"""SELECT project_code, start_date FROM projects
WHERE date_trunc('month', start_date) = date_trunc('month', {D})""")
def rel_19(v):
    return v.projects.where(erp.month_of("start_date", AS_OF)).select("project_code", "start_date")


@query("rel_20", f"""SELECT project_code, start_date FROM projects
WHERE start_date >= CAST({D} - INTERVAL 3 MONTH AS DATE) AND start_date <= {D}""")
def rel_20(v):
    return v.projects.where(erp.last_months("start_date", AS_OF, 3)).select("project_code", "start_date")


@query("rel_21", "SELECT contract_number, start_date FROM contracts WHERE start_date > DATE '2000-06-01'")
def rel_21(v):
    return v.contracts.where(F.col("start_date") > F.lit(dt.date(2000, 6, 1))).select("contract_number", "start_date")


@query("rel_22", """SELECT project_code, CAST(date_diff('day', start_date, end_date) AS BIGINT) AS duration_days
FROM projects WHERE date_diff('day', start_date, end_date) > 365""")
def rel_22(v):
    p = v.projects
    dd = F.datediff("end_date", "start_date")
    return p.where(dd > 365).select("project_code", dd.cast("bigint").alias("duration_days"))


@query("rel_23", f"""SELECT project_code, CASE WHEN end_date < {D} THEN 'Completed' WHEN start_date > {D}
THEN 'Not Started' ELSE 'In Progress' END AS timeline FROM projects""")
def rel_23(v):
    p = v.projects
    return p.select("project_code", erp.timeline_status(F.col("start_date"), F.col("end_date"), AS_OF).alias("timeline"))


@query("rel_24", f"""SELECT project_code, end_date, status FROM projects WHERE end_date < {D} AND status != 'Completed'""")
def rel_24(v):
    p = v.projects
    return p.where((F.col("end_date") < F.lit(AS_OF)) & (F.col("status") != "Completed")).select(
        "project_code", "end_date", "status")


@query("rel_24_expiring", f"""SELECT contract_number, end_date FROM contracts
WHERE year(end_date) = year({D}) AND end_date >= {D}""")
def rel_24_expiring(v):
    c = v.contracts
    return c.where(erp.year_range("end_date", AS_OF.year) & (F.col("end_date") >= F.lit(AS_OF))).select(
        "contract_number", "end_date")


@query("rel_25", """SELECT staff_id, project_code, start_date FROM staff
WHERE start_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""")
def rel_25(v):
    s = v.staff
    return s.where(F.col("start_date").between(F.lit(dt.date(1998, 1, 1)), F.lit(dt.date(1998, 3, 31)))).select(
        "staff_id", "project_code", "start_date")


# ------------------------------------------------------------ JOIN


@query("join_01", """SELECT p.project_code, p.project_name, ct.contract_number, ct.contract_value
FROM projects p JOIN contracts ct ON p.project_code = ct.project_code""")
def join_01(v):
    return v.projects.join(v.contracts.select("project_code", "contract_number", "contract_value"), "project_code").select(
        "project_code", "project_name", "contract_number", "contract_value")


@query("join_02", """SELECT p.project_name, s.role, r.resource_name FROM projects p
JOIN staff s ON p.project_code = s.project_code JOIN resources r ON s.resource_code = r.resource_code""")
def join_02(v):
    p = v.projects.select("project_code", "project_name")
    s = v.staff.select("project_code", "resource_code", "role")
    r = v.resources.select("resource_code", "resource_name")
    return p.join(s, "project_code").join(r, "resource_code").select("project_name", "role", "resource_name")


@query("join_02_contract", """SELECT p.project_code, ct.contract_number, c.company_name FROM projects p
JOIN contracts ct ON p.project_code = ct.project_code JOIN companies c ON ct.company_code = c.company_code""")
def join_02_contract(v):
    p = v.projects.select("project_code")
    ct = v.contracts.select("project_code", "contract_number", "company_code")
    c = v.companies.select("company_code", "company_name")
    return p.join(ct, "project_code").join(c, "company_code").select("project_code", "contract_number", "company_name")


@query("join_03", """SELECT c.company_name, k.contact_name FROM companies c LEFT JOIN contacts k ON c.company_id = k.company_id""")
def join_03(v):
    c = v.companies.select("company_id", "company_name")
    k = v.contacts.select("company_id", "contact_name")
    return c.join(k, "company_id", "left").select("company_name", "contact_name")


@query("join_04", f"""SELECT r.resource_code, COUNT(s.staff_id) AS assignments, COALESCE(SUM(s.allocation_percent), 0) AS allocated
FROM resources r LEFT JOIN staff s ON r.resource_code = s.resource_code AND s.status = 'Assigned'
AND (s.end_date IS NULL OR s.end_date >= {D}) GROUP BY r.resource_code""")
def join_04(v):
    r = v.resources.select("resource_code")
    s = v.staff
    on = ((r.resource_code == s.resource_code) & (s.status == "Assigned")
          & (s.end_date.isNull() | (s.end_date >= F.lit(AS_OF))))
    return r.join(s, on, "left").groupBy(r.resource_code).agg(
        F.count(s.staff_id).alias("assignments"),
        F.coalesce(F.sum(s.allocation_percent), F.lit(0.0)).alias("allocated"))


@query("join_05", """SELECT p.project_code, p.project_name FROM projects p LEFT JOIN staff s ON p.project_code = s.project_code
WHERE s.project_code IS NULL""")
def join_05(v):
    return v.projects.join(v.staff.select("project_code"), "project_code", "left_anti").select("project_code", "project_name")


@query("join_06", """SELECT resource_code, resource_name FROM resources WHERE resource_code NOT IN (SELECT resource_code FROM staff)""")
def join_06(v):
    return erp.not_in(v.resources, v.staff, "resource_code", "resource_code").select("resource_code", "resource_name")


@query("join_07", """SELECT c.company_code, c.company_name FROM companies c
WHERE NOT EXISTS (SELECT 1 FROM contracts ct WHERE ct.company_code = c.company_code)""")
def join_07(v):
    return v.companies.join(v.contracts.select("company_code"), "company_code", "left_anti").select(
        "company_code", "company_name")


@query("join_08", """SELECT project_code, project_name FROM projects
WHERE project_code IN (SELECT DISTINCT project_code FROM contracts)""")
def join_08(v):
    return v.projects.join(v.contracts.select("project_code"), "project_code", "left_semi").select(
        "project_code", "project_name")


@query("join_09", """SELECT c.company_id, c.company_name FROM companies c
WHERE EXISTS (SELECT 1 FROM contacts k WHERE k.company_id = c.company_id)""")
def join_09(v):
    return v.companies.join(v.contacts.select("company_id"), "company_id", "left_semi").select("company_id", "company_name")


@query("join_10", """SELECT COALESCE(p.project_code, ct.project_code) AS project_code, p.budget, ct.contract_value
FROM (SELECT * FROM projects WHERE budget > 400000) p
FULL OUTER JOIN (SELECT * FROM contracts WHERE contract_value > 400000) ct ON p.project_code = ct.project_code""")
def join_10(v):
    p = v.projects.where(F.col("budget") > 400000).select("project_code", "budget")
    ct = v.contracts.where(F.col("contract_value") > 400000).select("project_code", "contract_value")
    return p.join(ct, "project_code", "full").select("project_code", "budget", "contract_value")


@query("join_10_right", """SELECT ct.contract_number, p.project_name FROM (SELECT * FROM projects WHERE department = '1-URGENT') p
RIGHT JOIN contracts ct ON p.project_code = ct.project_code""")
def join_10_right(v):
    p = v.projects.where(F.col("department") == "1-URGENT").select("project_code", "project_name")
    ct = v.contracts.select("project_code", "contract_number")
    return p.join(ct, "project_code", "right").select("contract_number", "project_name")


@query("join_11", """SELECT c.project_id, c.project_name, par.project_name AS parent_name
FROM srm_projects c JOIN srm_projects par ON c.parent_id = par.project_id""")
def join_11(v):
    c = v.srm_projects.alias("c")
    par = v.srm_projects.alias("par")
    return c.join(par, F.col("c.parent_id") == F.col("par.project_id")).select(
        F.col("c.project_id"), F.col("c.project_name"), F.col("par.project_name").alias("parent_name"))


# ------------------------------------------------------------ AGG


@query("agg_01", "SELECT COUNT(*) AS n FROM projects")
def agg_01(v):
    return v.projects.agg(F.count(F.lit(1)).alias("n"))


@query("agg_02", """SELECT floor(SUM(budget) * 100 + 0.5) / 100 AS total_budget, floor(AVG(budget) * 10000 + 0.5) / 10000 AS avg_budget,
MIN(budget) AS min_budget, MAX(budget) AS max_budget FROM projects""")
def agg_02(v):
    return v.projects.agg(r2(F.sum("budget")).alias("total_budget"), r4(F.avg("budget")).alias("avg_budget"),
                          F.min("budget").alias("min_budget"), F.max("budget").alias("max_budget"))


@query("agg_03", """SELECT COUNT(*) AS n, floor(SUM(budget) * 100 + 0.5) / 100 AS total_budget FROM projects WHERE status = 'Active'""")
def agg_03(v):
    return v.projects.where(F.col("status") == "Active").agg(
        F.count(F.lit(1)).alias("n"), r2(F.sum("budget")).alias("total_budget"))


@query("agg_04", "SELECT status, COUNT(*) AS n FROM projects GROUP BY status")
def agg_04(v):
    return v.projects.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_05", "SELECT department, floor(SUM(budget) * 100 + 0.5) / 100 AS total_budget FROM projects GROUP BY department")
def agg_05(v):
    return v.projects.groupBy("department").agg(r2(F.sum("budget")).alias("total_budget"))


@query("agg_06", "SELECT department, floor(AVG(budget) * 10000 + 0.5) / 10000 AS avg_budget FROM projects GROUP BY department")
def agg_06(v):
    return v.projects.groupBy("department").agg(r4(F.avg("budget")).alias("avg_budget"))


@query("agg_07", "SELECT status, MAX(budget) AS max_budget FROM projects GROUP BY status")
def agg_07(v):
    return v.projects.groupBy("status").agg(F.max("budget").alias("max_budget"))


@query("agg_08", """SELECT department, COUNT(*) AS n, floor(SUM(budget) * 100 + 0.5) / 100 AS total_budget,
floor(AVG(actual_cost) * 10000 + 0.5) / 10000 AS avg_cost, MAX(revenue) AS max_revenue, MIN(budget) AS min_budget
FROM projects GROUP BY department""")
def agg_08(v):
    return v.projects.groupBy("department").agg(
        F.count(F.lit(1)).alias("n"), r2(F.sum("budget")).alias("total_budget"),
        r4(F.avg("actual_cost")).alias("avg_cost"), F.max("revenue").alias("max_revenue"),
        F.min("budget").alias("min_budget"))


@query("agg_09", """SELECT c.company_code, COUNT(DISTINCT ct.project_code) AS n_projects
FROM companies c LEFT JOIN contracts ct ON c.company_code = ct.company_code GROUP BY c.company_code""")
def agg_09(v):
    c = v.companies.select("company_code")
    ct = v.contracts.select("company_code", "project_code")
    return c.join(ct, "company_code", "left").groupBy("company_code").agg(
        F.countDistinct("project_code").alias("n_projects"))


@query("agg_09_rollup", """SELECT c.company_code, COUNT(DISTINCT ct.project_code) AS n_projects
FROM companies c LEFT JOIN contracts ct ON c.company_code = ct.company_code GROUP BY c.company_code""")
def agg_09_rollup(v):
    """AGG-09 at scale: distinct-count sketches per company and month, merged per company (small counts are exact)."""
    monthly = sketches.distinct_sketches(
        v.contracts.withColumn("month", F.date_trunc("month", "start_date")), ["company_code", "month"], "project_code")
    per_company = sketches.merged_distinct(monthly, ["company_code"], "n_projects")
    return v.companies.select("company_code").join(per_company, "company_code", "left").select(
        "company_code", F.coalesce("n_projects", F.lit(0)).alias("n_projects"))


@query("agg_10", """SELECT project_code, floor(SUM(allocation_percent * bill_rate / 100) * 100 + 0.5) / 100 AS weighted_rate
FROM staff GROUP BY project_code""")
def agg_10(v):
    return v.staff.groupBy("project_code").agg(
        r2(F.sum(F.col("allocation_percent") * F.col("bill_rate") / 100)).alias("weighted_rate"))


@query("agg_11", """SELECT CAST(year(start_date) AS INTEGER) AS start_year, COUNT(*) AS n,
floor(SUM(budget) * 100 + 0.5) / 100 AS total_budget FROM projects GROUP BY year(start_date)""")
def agg_11(v):
    return v.projects.groupBy(F.year("start_date").cast("int").alias("start_year")).agg(
        F.count(F.lit(1)).alias("n"), r2(F.sum("budget")).alias("total_budget"))


@query("agg_12", """SELECT company_code, COUNT(*) AS n_contracts, floor(SUM(contract_value) * 100 + 0.5) / 100 AS total_value
FROM contracts GROUP BY company_code HAVING COUNT(*) >= 5""")
def agg_12(v):
    return v.contracts.groupBy("company_code").agg(
        F.count(F.lit(1)).alias("n_contracts"), r2(F.sum("contract_value")).alias("total_value")
    ).where(F.col("n_contracts") >= 5)


@query("agg_13", "SELECT staff_id, COUNT(*) AS n FROM staff GROUP BY staff_id HAVING COUNT(*) > 1")
def agg_13(v):
    return v.staff.groupBy("staff_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


@query("agg_14", """SELECT department, floor(SUM(budget) * 100 + 0.5) / 100 AS total_budget FROM projects
GROUP BY department ORDER BY SUM(budget) DESC, department LIMIT 1""")
def agg_14(v):
    g = v.projects.groupBy("department").agg(F.sum("budget").alias("__t"))
    return erp.top_n(g, 1, [F.col("__t").desc(), F.col("department")]).select(
        "department", r2("__t").alias("total_budget"))


@query("agg_15", """SELECT c.company_name, floor(SUM(ct.contract_value) * 100 + 0.5) / 100 AS total_value
FROM companies c JOIN contracts ct ON c.company_code = ct.company_code
GROUP BY c.company_name HAVING SUM(ct.contract_value) > 1000000 ORDER BY total_value DESC""")
def agg_15(v):
    c = v.companies.select("company_code", "company_name")
    ct = v.contracts.select("company_code", "contract_value")
    g = c.join(ct, "company_code").groupBy("company_name").agg(F.sum("contract_value").alias("__t"))
    return g.where(F.col("__t") > 1000000).select("company_name", r2("__t").alias("total_value")).orderBy(
        F.col("total_value").desc())


@query("agg_16", f"""SELECT r.resource_code, r.resource_name, COALESCE(SUM(s.allocation_percent), 0) AS allocated
FROM resources r LEFT JOIN staff s ON r.resource_code = s.resource_code AND s.status = 'Assigned'
GROUP BY r.resource_code, r.resource_name HAVING COALESCE(SUM(s.allocation_percent), 0) < 5000""")
def agg_16(v):
    s = v.staff.where(F.col("status") == "Assigned").groupBy("resource_code").agg(
        F.sum("allocation_percent").alias("__a"))
    return (v.resources.select("resource_code", "resource_name").join(s, "resource_code", "left")
            .select("resource_code", "resource_name", F.coalesce("__a", F.lit(0.0)).alias("allocated"))
            .where(F.col("allocated") < 5000))


@query("agg_17", """WITH per_project AS (SELECT project_code, COUNT(*) AS n_staff FROM staff GROUP BY project_code)
SELECT p.department, floor(AVG(pp.n_staff) * 10000 + 0.5) / 10000 AS avg_staff, MAX(pp.n_staff) AS max_staff
FROM per_project pp JOIN projects p ON p.project_code = pp.project_code GROUP BY p.department""")
def agg_17(v):
    pp = v.staff.groupBy("project_code").agg(F.count(F.lit(1)).alias("n_staff"))
    return pp.join(v.projects.select("project_code", "department"), "project_code").groupBy("department").agg(
        r4(F.avg("n_staff")).alias("avg_staff"), F.max("n_staff").alias("max_staff"))


# ------------------------------------------------------------ SUB / SET


@query("sub_01", "SELECT project_code, budget FROM projects WHERE budget > (SELECT AVG(budget) FROM projects)")
def sub_01(v):
    p = v.projects
    avg = p.agg(F.avg("budget")).scalar()  # scalar subquery, evaluated once
    return p.where(F.col("budget") > avg).select("project_code", "budget")


@query("sub_02", """SELECT project_code, budget FROM projects
WHERE budget > (SELECT AVG(budget) FROM projects WHERE department = '1-URGENT')""")
def sub_02(v):
    p = v.projects
    avg = p.where(F.col("department") == "1-URGENT").agg(F.avg("budget")).scalar()
    return p.where(F.col("budget") > avg).select("project_code", "budget")


@query("sub_03", """SELECT p.project_code, p.department, p.budget FROM projects p
WHERE p.budget > (SELECT AVG(q.budget) FROM projects q WHERE q.department = p.department)""")
def sub_03(v):
    return erp.with_department_average(v.projects).where(F.col("budget") > F.col("dept_avg_budget")).select(
        "project_code", "department", "budget")


@query("sub_04", """WITH dept AS (SELECT department, SUM(budget) AS total FROM projects GROUP BY department),
avg_dept AS (SELECT AVG(total) AS avg_total FROM dept)
SELECT d.department, floor(d.total * 100 + 0.5) / 100 AS total_budget FROM dept d, avg_dept a WHERE d.total > a.avg_total""")
def sub_04(v):
    dept = v.projects.groupBy("department").agg(F.sum("budget").alias("total"))
    avg_total = dept.agg(F.avg("total")).scalar()
    return dept.where(F.col("total") > avg_total).select("department", r2("total").alias("total_budget"))


# every row's chain of parents, level by level, at most five levels
HIERARCHY_SQL = """h(project_id, at_id, up_id, depth, there, seen) AS (
  SELECT project_id, project_id, parent_id, 1, TRUE, [project_id] FROM srm_projects
  UNION ALL
  SELECT h.project_id, h.up_id, c.parent_id, h.depth + 1, c.project_id IS NOT NULL, list_append(h.seen, h.up_id)
  FROM h LEFT JOIN srm_projects c ON c.project_id = h.up_id
  WHERE h.there AND h.up_id IS NOT NULL AND NOT list_contains(h.seen, h.up_id)),
last AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY depth DESC) AS back FROM h),
outcomes AS (SELECT project_id, CASE WHEN there AND up_id IS NULL THEN at_id END AS root_id,
  CASE WHEN there AND up_id IS NULL THEN CAST(depth AS BIGINT) END AS depth,
  CASE WHEN NOT there THEN 'missing parent' WHEN up_id IS NULL THEN 'reached' ELSE 'cycle' END AS outcome,
  there AND up_id IS NULL AND depth <= 5 AS within_limit FROM last WHERE back = 1)"""


@query("sub_05", f"WITH RECURSIVE {HIERARCHY_SQL} SELECT project_id, root_id, depth, outcome, within_limit FROM outcomes")
def sub_05(v):
    return erp.hierarchy(v.srm_projects, max_depth=5)


@query("set_01", """SELECT project_code FROM contracts UNION SELECT project_code FROM staff WHERE role = 'Project Manager'""")
def set_01(v):
    a = v.contracts.select("project_code")
    b = v.staff.where(F.col("role") == "Project Manager").select("project_code")
    return a.union(b).distinct()


@query("set_02", """SELECT project_code FROM contracts INTERSECT SELECT project_code FROM staff WHERE role = 'Developer'""")
def set_02(v):
    a = v.contracts.select("project_code")
    b = v.staff.where(F.col("role") == "Developer").select("project_code")
    return a.intersect(b)


@query("set_02_except", """SELECT project_code FROM projects EXCEPT SELECT project_code FROM staff""")
def set_02_except(v):
    return v.projects.select("project_code").subtract(v.staff.select("project_code"))


# ------------------------------------------------------------ WIN / SORT


@query("win_01", "SELECT project_code, budget, CAST(RANK() OVER (ORDER BY budget DESC) AS INTEGER) AS budget_rank FROM projects")
def win_01(v):
    p = v.projects.select("project_code", "budget")
    return global_rank(p, "budget", descending=True, out="budget_rank")


@query("win_02", """SELECT project_code, start_date, budget,
floor(SUM(budget) OVER (ORDER BY start_date) * 100 + 0.5) / 100 AS running_budget FROM projects""")
def win_02(v):
    p = v.projects.select("project_code", "start_date", "budget")
    out = global_running_sum(p, "start_date", "budget", out="__run")
    return out.select("project_code", "start_date", "budget", r2("__run").alias("running_budget"))


@query("win_03", """SELECT staff_id, resource_code, start_date,
CAST(ROW_NUMBER() OVER (PARTITION BY resource_code ORDER BY start_date, staff_id, project_code, role, allocation_percent,
  bill_rate, cost_rate, status, end_date) AS INTEGER) AS assignment_no,
CAST(DENSE_RANK() OVER (PARTITION BY resource_code ORDER BY start_date) AS INTEGER) AS start_rank FROM staff""")
def win_03(v):
    return erp.nth_assignment(v.staff).select("staff_id", "resource_code", "start_date", "assignment_no", "start_rank")


@query("sort_01", "SELECT project_code, budget FROM projects ORDER BY budget DESC")
def sort_01(v):
    return v.projects.select("project_code", "budget").orderBy(F.col("budget").desc())


@query("sort_02", "SELECT project_code, budget FROM projects ORDER BY budget DESC, project_code LIMIT 10")
def sort_02(v):
    return erp.top_n(v.projects.select("project_code", "budget"), 10, [F.col("budget").desc(), F.col("project_code")])


@query("sort_03", """SELECT DISTINCT r.resource_name FROM staff s JOIN resources r ON s.resource_code = r.resource_code
WHERE s.role = 'Project Manager'""")
def sort_03(v):
    s = v.staff.where(F.col("role") == "Project Manager").select("resource_code")
    return s.join(v.resources.select("resource_code", "resource_name"), "resource_code").select("resource_name").distinct()


# ------------------------------------------------------------ DML


def _versions(v, change) -> DataFrame:
    """The projects as a versioned table, changed once; both versions read back."""
    table = VersionedTable.create(v.projects, scratch_path(v.spark, "projects-table"))
    change(table)
    return table.read(0).withColumn("version", F.lit(0)).unionByName(table.read().withColumn("version", F.lit(1)))


@query("dml_01", """SELECT *, 0 AS version FROM projects UNION ALL
SELECT project_id, project_code, project_name, budget, actual_cost, revenue, department,
CASE WHEN actual_cost > budget * 1.2 THEN 'On Hold' ELSE status END AS status, start_date, end_date, 1 FROM projects""")
def dml_01(v):
    return _versions(v, lambda t: t.update(F.col("actual_cost") > F.col("budget") * 1.2, {"status": F.lit("On Hold")}))


@query("dml_02", """SELECT *, 0 AS version FROM projects UNION ALL SELECT *, 1 FROM projects UNION ALL
SELECT 99999999, '99999999', 'PRJ-NEW', 250000.0, 0.0, 0.0, '3-MEDIUM', 'Active', DATE '2000-01-01', NULL, 1""")
def dml_02(v):
    row = {"project_id": 99999999, "project_code": "99999999", "project_name": "PRJ-NEW", "budget": 250000.0,
           "actual_cost": 0.0, "revenue": 0.0, "department": "3-MEDIUM", "status": "Active",
           "start_date": AS_OF, "end_date": None}
    return _versions(v, lambda t: t.insert([row]))


@query("dml_03", """SELECT *, 0 AS version FROM projects UNION ALL
SELECT *, 1 FROM projects WHERE NOT COALESCE(end_date < start_date, FALSE)""")
def dml_03(v):
    return _versions(v, lambda t: t.delete(F.col("end_date") < F.col("start_date")))


# ------------------------------------------------------------ VIEWS


@query("view_1", """SELECT p.project_code, p.project_name, c.company_name, c.company_code, p.budget, p.actual_cost, p.revenue,
p.revenue - p.actual_cost AS profit, p.start_date, p.end_date, p.status
FROM projects p LEFT JOIN contracts ct ON p.project_code = ct.project_code
LEFT JOIN companies c ON ct.company_code = c.company_code WHERE p.status = 'Active'""")
def view_1(v):
    return erp.active_projects(v.projects, v.contracts, v.companies)


VIEW_2_SQL = f"""SELECT r.resource_code, r.resource_name, r.resource_type, COUNT(DISTINCT s.project_code) AS projects_count,
SUM(s.allocation_percent) AS total_allocation, r.capacity,
r.capacity - COALESCE(SUM(s.allocation_percent), 0) AS available_capacity
FROM resources r LEFT JOIN staff s ON r.resource_code = s.resource_code AND s.status = 'Assigned'
AND (s.end_date IS NULL OR s.end_date >= {D})
GROUP BY r.resource_code, r.resource_name, r.resource_type, r.capacity"""


@query("view_2", VIEW_2_SQL)
def view_2(v):
    return erp.resource_allocation(v.resources, v.staff, AS_OF)


@query("view_3", """SELECT p.project_code, p.project_name, p.budget, p.actual_cost, p.revenue, ct.contract_value,
COUNT(DISTINCT s.staff_id) AS staff_count,
floor(SUM(s.allocation_percent * s.cost_rate) * 100 + 0.5) / 100 AS total_staff_cost,
p.budget - p.actual_cost AS budget_variance,
floor(CASE WHEN p.budget > 0 THEN p.actual_cost / p.budget * 100 ELSE 0 END * 10000 + 0.5) / 10000 AS budget_utilization_percent
FROM projects p LEFT JOIN contracts ct ON p.project_code = ct.project_code LEFT JOIN staff s ON p.project_code = s.project_code
GROUP BY p.project_code, p.project_name, p.budget, p.actual_cost, p.revenue, ct.contract_value""")
def view_3(v):
    return erp.financial_summary(v.projects, v.contracts, v.staff, pre_aggregated=False)


@query("view_3_preagg", """WITH base AS (SELECT DISTINCT p.project_code, p.project_name, p.budget, p.actual_cost, p.revenue, ct.contract_value
  FROM projects p LEFT JOIN contracts ct ON p.project_code = ct.project_code),
per AS (SELECT project_code, COUNT(DISTINCT staff_id) AS staff_count, SUM(allocation_percent * cost_rate) AS tsc
  FROM staff GROUP BY project_code)
SELECT b.project_code, b.project_name, b.budget, b.actual_cost, b.revenue, b.contract_value,
COALESCE(per.staff_count, 0) AS staff_count, floor(per.tsc * 100 + 0.5) / 100 AS total_staff_cost,
b.budget - b.actual_cost AS budget_variance,
floor(CASE WHEN b.budget > 0 THEN b.actual_cost / b.budget * 100 ELSE 0 END * 10000 + 0.5) / 10000 AS budget_utilization_percent
FROM base b LEFT JOIN per ON b.project_code = per.project_code""")
def view_3_preagg(v):
    return erp.financial_summary(v.projects, v.contracts, v.staff, pre_aggregated=True)
