"""SQL text of the fixture views (see FIXTURES.md), for DuckDB oracles.

The driver registers only base tables, so every oracle query inlines the
views it needs as CTEs via :func:`with_views`.
"""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {}

VIEW_SQL["companies"] = """
SELECT c_custkey AS company_id, 'C' || CAST(c_custkey AS STRING) AS company_code, c_name AS company_name, c_mktsegment AS industry,
  CASE WHEN c_acctbal < 0 THEN 'Inactive' ELSE 'Active' END AS status FROM customer
"""

VIEW_SQL["contacts"] = """
SELECT c_custkey * 10 AS contact_id, CASE WHEN c_custkey % 4 = 0 THEN -c_custkey ELSE c_custkey END AS company_id, 'Contact ' || CAST(c_custkey AS STRING) AS contact_name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'u' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '555-' || CAST(c_custkey AS STRING) END AS phone
FROM customer
"""

VIEW_SQL["projects"] = """
SELECT o_orderkey AS project_id, CAST(o_orderkey AS STRING) AS project_code, 'PRJ-' || CAST(o_orderkey AS STRING) AS project_name,
  o_totalprice AS budget,
  CAST(floor(o_totalprice * (5 + o_orderkey % 8) / 10) AS DOUBLE) AS actual_cost,
  CAST(floor(o_totalprice * (6 + o_custkey % 9) / 10) AS DOUBLE) AS revenue,
  o_orderpriority AS department,
  CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Completed' ELSE 'On Hold' END AS status,
  CAST(o_orderdate AS DATE) AS start_date,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 700 - 20 AS INT) END AS end_date
FROM orders
"""

VIEW_SQL["srm_projects"] = """
SELECT o_orderkey AS project_id, 'PRJ-' || CAST(o_orderkey AS STRING) AS project_name, o_custkey AS company_id,
  CASE WHEN floor(o_orderkey / 100) % 8 = 3 AND o_orderkey % 100 < 63
    THEN CASE o_orderkey % 100 WHEN 0 THEN NULL WHEN 40 THEN o_orderkey + 6 WHEN 56 THEN o_orderkey + 1
           WHEN 61 THEN o_orderkey ELSE o_orderkey - 1 END
    WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 10) AS BIGINT) END AS parent_id FROM orders
"""

VIEW_SQL["resources"] = """
SELECT 'R' || CAST(s_suppkey AS STRING) AS resource_code, s_name AS resource_name,
  CASE s_nationkey % 3 WHEN 0 THEN 'Human' WHEN 1 THEN 'Equipment' ELSE 'Material' END AS resource_type,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'r' || CAST(s_suppkey AS STRING) || '@example.com' END AS email,
  CAST(50 + s_suppkey % 150 AS DOUBLE) AS cost_rate, CAST(48 + s_suppkey % 150 + s_suppkey % 40 AS DOUBLE) AS billing_rate,
  CAST(40 + s_suppkey % 80 AS DOUBLE) AS capacity,
  CASE s_suppkey % 4 WHEN 0 THEN 'Busy' WHEN 1 THEN 'Unavailable' ELSE 'Available' END AS availability FROM supplier
"""

VIEW_SQL["staff"] = """
SELECT l_orderkey * 100 + l_linenumber AS staff_id, CAST(l_orderkey AS STRING) AS project_code,
  CASE WHEN l_suppkey % 11 = 0 THEN 'X' ELSE 'R' END || CAST(l_suppkey AS STRING) AS resource_code,
  CASE l_returnflag WHEN 'A' THEN 'Developer' WHEN 'N' THEN 'Project Manager' ELSE 'Analyst' END AS role,
  l_quantity AS allocation_percent, CAST(floor(l_extendedprice / l_quantity) AS DOUBLE) AS bill_rate,
  CAST(floor(l_extendedprice * (1 - l_discount) / l_quantity) AS DOUBLE) AS cost_rate,
  CASE l_linestatus WHEN 'O' THEN 'Assigned' ELSE 'Released' END AS status, CAST(l_shipdate AS DATE) AS start_date,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_partkey % 300 AS INT) END AS end_date
FROM lineitem
"""

VIEW_SQL["contracts"] = """
SELECT o_orderkey AS contract_id, 'CT-' || CAST(o_orderkey AS STRING) AS contract_number, CAST(o_orderkey AS STRING) AS project_code,
  'C' || CAST(o_custkey AS STRING) AS company_code,
  CASE o_orderkey % 3 WHEN 0 THEN 'Fixed Price' WHEN 1 THEN 'Time and Materials' ELSE 'Retainer' END AS contract_type,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE CAST(floor(o_totalprice * 9 / 10) AS DOUBLE) END AS contract_value,
  CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 365 AS end_date,
  CASE o_orderkey % 4 WHEN 0 THEN 'Draft' ELSE 'Active' END AS status FROM orders WHERE o_orderstatus = 'F'
"""

VIEW_SQL["tickets"] = """
SELECT event_id AS support_id, 'C' || CAST(user_id AS STRING) AS company_code, event_type AS support_type,
  CASE WHEN value > 100 THEN 'High' WHEN value > 30 THEN 'Medium' ELSE 'Low' END AS priority,
  CASE WHEN event_id % 101 = 0 THEN 'Escalated' WHEN event_id % 4 = 0 THEN 'Open' WHEN event_id % 4 = 1 THEN 'In Progress'
    WHEN event_id % 4 = 2 THEN 'Resolved' ELSE 'Closed' END AS status,
  CAST(ts AS DATE) AS reported_date FROM events
"""

VIEW_SQL["revisions"] = """
SELECT event_id AS revision_id, CAST(event_id AS STRING) AS project_code, CAST(ts AS DATE) AS revision_date,
  CASE event_type WHEN 'view' THEN 'Scope Change' ELSE 'Budget Update' END AS revision_type FROM events WHERE event_type IN ('view', 'click')
"""

VIEW_SQL["opportunities"] = """
SELECT c_custkey AS opportunity_id, c_custkey AS company_id, c_acctbal AS estimated_value, CAST(c_custkey % 101 AS DOUBLE) AS probability,
  CASE c_custkey % 5 WHEN 0 THEN 'Lead' WHEN 1 THEN 'Qualified' WHEN 2 THEN 'Proposal' WHEN 3 THEN 'Negotiation' ELSE 'Closed' END AS stage,
  CASE WHEN c_acctbal < 0 THEN 'Lost' ELSE 'Active' END AS status FROM customer
"""

VIEW_SQL["pairs"] = """
SELECT o_orderkey AS pair_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'Show staff of project ' WHEN 1 THEN 'Find the budget of project ' WHEN 2 THEN 'Count contracts signed this month for company '
    WHEN 3 THEN 'List resources on project today ' WHEN 4 THEN 'Total spend this year per department above ' ELSE 'Which companies have no contact in group ' END
    || CAST(o_orderkey // 250 AS STRING) AS query,
  CASE o_orderkey % 6
    WHEN 0 THEN 'SELECT s.Role FROM PROJSTAFF s WHERE s.Project_Code = ''' || CAST(o_orderkey // 250 AS STRING) || ''''
    WHEN 1 THEN 'SELECT Budget FROM PAC_MNT_PROJECTS WHERE Project_Code = ''' || CAST(o_orderkey // 250 AS STRING) || ''' LIMIT 1;'
    WHEN 2 THEN 'SELECT COUNT(*) AS n FROM PROJCNTRTS WHERE Company_Code = ''C' || CAST(o_orderkey // 250 AS STRING) || ''''
    WHEN 3 THEN 'SELECT r.Resource_Name FROM PAC_MNT_PROJECTS p JOIN PROJSTAFF s ON p.Project_Code = s.Project_Code JOIN PAC_MNT_RESOURCES r ON s.Resource_Code = r.Resource_Code WHERE p.Project_Code = ''' || CAST(o_orderkey // 250 AS STRING) || ''''
    WHEN 4 THEN 'SELECT Department, SUM(Actual_Cost) AS spend FROM PAC_MNT_PROJECTS GROUP BY Department HAVING SUM(Actual_Cost) > ' || CAST(o_orderkey // 250 AS STRING) || ' ORDER BY spend DESC'
    ELSE 'SELECT c.Company_Name FROM SRM_COMPANIES c LEFT JOIN SRM_CONTACTS k ON c.Company_ID = k.Company_ID WHERE k.Contact_ID IS NULL AND c.Company_ID > ' || CAST(o_orderkey // 250 AS STRING) END AS sql,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Filter one table'
    WHEN 2 THEN 'Step 1: pick the table. Step 2: filter rows because one project is asked for.'
    ELSE 'First find the table, then join on the key column since two tables are needed; finally group.' END AS reasoning,
  CASE o_orderstatus WHEN 'O' THEN 'projects' WHEN 'F' THEN 'reporting' ELSE 'resources' END AS domain FROM orders
"""

VIEW_SQL["candidates"] = """
SELECT l.l_orderkey AS prompt_id, l.l_linenumber * 1000000 + l.l_partkey AS cand_id, p.query AS query, p.sql AS expected_sql,
  CASE l.l_partkey % 13 WHEN 0 THEN p.sql WHEN 1 THEN lower(p.sql) || ';'
    WHEN 2 THEN 'SELECT * FROM projects WHERE status = ''Active''' WHEN 3 THEN 'SELECT (Budget FROM PAC_MNT_PROJECTS'
    WHEN 4 THEN 'SELECT * FROM PAC_MNT_PROJECTS WHERE Budget < -5' WHEN 5 THEN 'SELECT Department FROM PAC_MNT_PROJECTS GROUP BY Department'
    WHEN 6 THEN 'SELECT * FROM PROJSTAFF; DROP TABLE PROJSTAFF' WHEN 7 THEN 'SELECT s.Role FROM PROJSTAFF s WHERE s.Project_Code IN (SELECT Project_Code FROM PAC_MNT_PROJECTS WHERE Company_ID IN (SELECT Company_ID FROM SRM_COMPANIES))'
    WHEN 8 THEN 'SELECT a.Role FROM PROJSTAFF a'
      || ' JOIN PAC_MNT_PROJECTS p0 ON a.Project_Code = p0.Project_Code JOIN PAC_MNT_PROJECTS p1 ON a.Project_Code = p1.Project_Code'
      || ' JOIN PAC_MNT_PROJECTS p2 ON a.Project_Code = p2.Project_Code JOIN PAC_MNT_PROJECTS p3 ON a.Project_Code = p3.Project_Code'
      || ' JOIN PAC_MNT_PROJECTS p4 ON a.Project_Code = p4.Project_Code JOIN PAC_MNT_PROJECTS p5 ON a.Project_Code = p5.Project_Code'
      || ' JOIN PAC_MNT_PROJECTS p6 ON a.Project_Code = p6.Project_Code JOIN PAC_MNT_PROJECTS p7 ON a.Project_Code = p7.Project_Code'
    WHEN 9 THEN 'SELECT ''copied FROM backup, twice'' AS n FROM PAC_MNT_PROJECTS /* JOIN hidden h ON 1 = 1 */ WHERE Status = ''a -- b GROUP BY c'' AND Note = ''it''''s (one, LIMIT 5'''
    WHEN 10 THEN 'SELECT F(G(H(Role, 1), 2), 3), A(B(C(D(E(F(G(H(I(J(Role, 1), 2), 3), 4), 5), 6), 7), 8), 9), 10) AS r, COUNT(*) AS n FROM PROJSTAFF WHERE Status = ''Open'' GROUP BY F(G(H(Role, 1), 2), 3), Role'
    WHEN 11 THEN '-- don''t JOIN anything' || chr(10) || 'SELECT Company_Name FROM SRM_COMPANIES -- FROM old_companies' || chr(10) || 'ORDER BY Company_Name, "FROM x, y"'
    ELSE 'DELETE FROM SRM_CONTACTS' END AS sql,
  CASE l.l_suppkey % 3 WHEN 0 THEN '' ELSE p.reasoning END AS reasoning
FROM lineitem l JOIN pairs p ON l.l_orderkey = p.pair_id
"""

VIEW_SQL["generations"] = """
SELECT prompt_id, cand_id, expected_sql, CASE prompt_id % 3 WHEN 0 THEN 'Base' WHEN 1 THEN 'SFT' ELSE 'GRPO' END AS model,
  CASE cand_id % 97 WHEN 0 THEN NULL ELSE CASE cand_id % 4 WHEN 0 THEN '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || chr(10) || sql || '<|im_end|>'
    WHEN 1 THEN 'Here it is:' || chr(10) || '```sql' || chr(10) || sql || chr(10) || '```' WHEN 2 THEN sql ELSE 'I cannot answer that' END END AS text,
  CAST(cand_id % 40 AS DOUBLE) / 8 AS seconds, CASE WHEN cand_id % 97 = 0 THEN 'timeout' END AS error
FROM candidates
"""

VIEW_SQL["run_logs"] = """
SELECT event_id, ts, 'run-' || CAST(user_id // 7 AS STRING) AS run_id,
  CASE event_type WHEN 'error' THEN 'ERROR: step failed' WHEN 'click' THEN 'WARNING: slow batch' WHEN 'purchase' THEN 'SUCCESS checkpoint saved'
    WHEN 'signup' THEN 'epoch 1 loss ' || CAST(event_id % 7 AS STRING) ELSE 'step ' || CAST(event_id AS STRING) END AS message,
  CASE WHEN event_id % 50 = 49 THEN 'Completed' WHEN event_type = 'error' THEN 'Failed' ELSE 'InProgress' END AS status, value AS seconds,
  CASE (user_id // 7) % 4 WHEN 0 THEN 'ml.g5.xlarge' WHEN 1 THEN 'ml.g4dn.xlarge' WHEN 2 THEN 'ml.p3.2xlarge' ELSE 'ml.g5.2xlarge' END AS instance FROM events
"""

VIEW_SQL["requests"] = """
SELECT event_id AS request_id, ts, 's' || CAST(user_id AS STRING) AS session_id, 'q' || CAST(event_id // 3 AS STRING) AS cache_key,
  value / 10 AS latency_s, event_type = 'error' AS failed, CAST(event_id % 11 AS DOUBLE) / 10 AS confidence,
  CASE event_id % 5 WHEN 0 THEN 'schema_analysis' WHEN 1 THEN 'query_generation' WHEN 2 THEN 'validation'
    WHEN 3 THEN 'reward_evaluation' ELSE 'finalize' END AS stage FROM events
"""


_ORDER = list(VIEW_SQL)


def _deps(sql: str, seen: set[str]) -> None:
    for name in _ORDER:
        if name not in seen and re.search(r"\b" + name + r"\b", sql):
            seen.add(name)
            _deps(VIEW_SQL[name], seen)


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every fixture view it references."""
    body = sql.strip()
    used: set[str] = set()
    _deps(body, used)
    if not used:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in _ORDER if n in used)
    m = re.match(r"WITH(\s+RECURSIVE)?\s", body, re.I)
    if m:
        head = "WITH RECURSIVE " if m.group(1) else "WITH "
        return head + ctes + ",\n" + body[m.end():].lstrip()
    return "WITH " + ctes + "\n" + body
