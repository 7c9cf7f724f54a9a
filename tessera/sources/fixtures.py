"""Logical ERP / corpus / log views derived from the driver tables.

Each view is a projection (plus at most one join) over a driver table, written
with built-in column expressions only, so the parquet scan receives just the
columns it needs. The same views in SQL form live in
``tessera.plans.oracle_views`` and are used as DuckDB oracles.

``as_of`` dates replace CURRENT_DATE so results are deterministic.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

# Reference dates used instead of CURRENT_DATE.
ERP_AS_OF = _dt.date(2000, 1, 1)
EVENT_AS_OF = _dt.date(2024, 1, 31)


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def _case(key: Column, mapping: list[tuple[object, object]], default: object) -> Column:
    out = None
    for k, v in mapping:
        cond = key == F.lit(k)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(default)


def candidate_columns(j: DataFrame) -> DataFrame:
    """Candidates from lineitem rows joined to their pair (batch and stream alike)."""
    sql = _case(F.col("l_partkey") % 13, [
        (0, F.col("p_sql")),
        (1, F.concat(F.lower("p_sql"), F.lit(";"))),
        (2, F.lit("SELECT * FROM projects WHERE status = 'Active'")),
        (3, F.lit("SELECT (Budget FROM PAC_MNT_PROJECTS")),
        (4, F.lit("SELECT * FROM PAC_MNT_PROJECTS WHERE Budget < -5")),
        (5, F.lit("SELECT Department FROM PAC_MNT_PROJECTS GROUP BY Department")),
        (6, F.lit("SELECT * FROM PROJSTAFF; DROP TABLE PROJSTAFF")),
        (7, F.lit("SELECT s.Role FROM PROJSTAFF s WHERE s.Project_Code IN (SELECT Project_Code FROM PAC_MNT_PROJECTS "
                  "WHERE Company_ID IN (SELECT Company_ID FROM SRM_COMPANIES))")),
        (8, F.lit("SELECT a.Role FROM PROJSTAFF a" + "".join(
            f" JOIN PAC_MNT_PROJECTS p{n} ON a.Project_Code = p{n}.Project_Code" for n in range(8)))),
        (9, F.lit("SELECT 'copied FROM backup, twice' AS n FROM PAC_MNT_PROJECTS /* JOIN hidden h ON 1 = 1 */ "
                  "WHERE Status = 'a -- b GROUP BY c' AND Note = 'it''s (one, LIMIT 5'")),
        (10, F.lit("SELECT F(G(H(Role, 1), 2), 3), A(B(C(D(E(F(G(H(I(J(Role, 1), 2), 3), 4), 5), 6), 7), 8), 9), 10) AS r, "
                   "COUNT(*) AS n FROM PROJSTAFF WHERE Status = 'Open' GROUP BY F(G(H(Role, 1), 2), 3), Role")),
        (11, F.lit("-- don't JOIN anything\nSELECT Company_Name FROM SRM_COMPANIES -- FROM old_companies\n"
                   "ORDER BY Company_Name, \"FROM x, y\"")),
    ], F.lit("DELETE FROM SRM_CONTACTS"))
    return j.select(
        F.col("l_orderkey").alias("prompt_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("cand_id"),
        F.col("query"),
        F.col("p_sql").alias("expected_sql"),
        sql.alias("sql"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.col("p_reasoning")).alias("reasoning"),
    )


def run_log_columns(events: DataFrame) -> DataFrame:
    """Run logs from events (batch and stream alike)."""
    et, eid = F.col("event_type"), F.col("event_id")
    message = _case(et, [
        ("error", F.lit("ERROR: step failed")), ("click", F.lit("WARNING: slow batch")),
        ("purchase", F.lit("SUCCESS checkpoint saved")),
        ("signup", F.concat(F.lit("epoch 1 loss "), _s(eid % 7))),
    ], F.concat(F.lit("step "), _s(eid)))
    return events.select(
        eid, F.col("ts"),
        F.concat(F.lit("run-"), _s(run_number())).alias("run_id"),
        message.alias("message"),
        F.when(eid % 50 == 49, "Completed").when(et == "error", "Failed").otherwise("InProgress").alias("status"),
        F.col("value").alias("seconds"),
        _case(run_number() % 4, [(0, "ml.g5.xlarge"), (1, "ml.g4dn.xlarge"), (2, "ml.p3.2xlarge")],
              "ml.g5.2xlarge").alias("instance"),
    )


def run_number() -> Column:
    """Seven users share a run, so runs grow with the users."""
    return F.floor(F.col("user_id") / 7).cast("bigint")


def cache_key() -> Column:
    """Three requests in a row share a key, so keys grow with the requests."""
    return F.concat(F.lit("q"), _s(F.floor(F.col("event_id") / 3).cast("bigint"))).alias("cache_key")


class Views:
    """All fixture views for one scale factor (lazy DataFrames)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # ---------------------------------------------------------------- ERP
    @cached_property
    def companies(self) -> DataFrame:
        c = self.t.customer
        return c.select(
            F.col("c_custkey").alias("company_id"),
            F.concat(F.lit("C"), _s("c_custkey")).alias("company_code"),
            F.col("c_name").alias("company_name"),
            F.col("c_mktsegment").alias("industry"),
            F.when(F.col("c_acctbal") < 0, "Inactive").otherwise("Active").alias("status"),
        )

    @cached_property
    def contacts(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        return c.select(
            (k * 10).alias("contact_id"),
            F.when(k % 4 == 0, -k).otherwise(k).alias("company_id"),  # a quarter has no company
            F.concat(F.lit("Contact "), _s(k)).alias("contact_name"),
            F.when(k % 5 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("u"), _s(k), F.lit("@example.com"))).alias("email"),
            F.when(k % 7 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("555-"), _s(k))).alias("phone"),
        )

    @cached_property
    def projects(self) -> DataFrame:
        o = self.t.orders
        k, price = F.col("o_orderkey"), F.col("o_totalprice")
        start = F.col("o_orderdate").cast("date")
        return o.select(
            k.alias("project_id"),
            _s(k).alias("project_code"),
            F.concat(F.lit("PRJ-"), _s(k)).alias("project_name"),
            price.alias("budget"),
            F.floor(price * (5 + k % 8) / 10).cast("double").alias("actual_cost"),
            F.floor(price * (6 + F.col("o_custkey") % 9) / 10).cast("double").alias("revenue"),
            F.col("o_orderpriority").alias("department"),
            _case(F.col("o_orderstatus"), [("O", "Active"), ("F", "Completed")], "On Hold").alias("status"),
            start.alias("start_date"),
            F.when(k % 37 == 0, F.lit(None).cast("date"))
            .otherwise(F.date_add(start, (k % 700 - 20).cast("int"))).alias("end_date"),
        )

    @cached_property
    def srm_projects(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        return o.select(
            k.alias("project_id"),
            F.concat(F.lit("PRJ-"), _s(k)).alias("project_name"),
            F.col("o_custkey").alias("company_id"),
            # in every eighth hundred: a chain of 40, a cycle of 7 with a chain of 9 that leads into it, a cycle of 2
            # with one of 3, and a row that is its own parent with one below it
            F.when((F.floor(k / 100) % 8 == 3) & (k % 100 < 63),
                   F.when(k % 100 == 0, F.lit(None).cast("bigint")).when(k % 100 == 40, k + 6).when(k % 100 == 56, k + 1)
                   .when(k % 100 == 61, k).otherwise(k - 1))
            .when(k % 10 == 0, F.lit(None).cast("bigint"))
            .otherwise(F.floor(k / 10).cast("bigint")).alias("parent_id"),
        )

    @cached_property
    def resources(self) -> DataFrame:
        s = self.t.supplier
        k = F.col("s_suppkey")
        return s.select(
            F.concat(F.lit("R"), _s(k)).alias("resource_code"),
            F.col("s_name").alias("resource_name"),
            _case(F.col("s_nationkey") % 3, [(0, "Human"), (1, "Equipment")], "Material").alias("resource_type"),
            F.when(k % 6 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("r"), _s(k), F.lit("@example.com"))).alias("email"),
            (50 + k % 150).cast("double").alias("cost_rate"),
            (48 + k % 150 + k % 40).cast("double").alias("billing_rate"),
            (40 + k % 80).cast("double").alias("capacity"),
            _case(k % 4, [(0, "Busy"), (1, "Unavailable")], "Available").alias("availability"),
        )

    @cached_property
    def staff(self) -> DataFrame:
        li = self.t.lineitem
        ship = F.col("l_shipdate").cast("date")
        q = F.col("l_quantity")
        resource = F.when(F.col("l_suppkey") % 11 == 0, "X").otherwise("R")  # X...: no such resource
        return li.select(
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("staff_id"),
            _s("l_orderkey").alias("project_code"),
            F.concat(resource, _s("l_suppkey")).alias("resource_code"),
            _case(F.col("l_returnflag"), [("A", "Developer"), ("N", "Project Manager")], "Analyst").alias("role"),
            q.alias("allocation_percent"),
            F.floor(F.col("l_extendedprice") / q).cast("double").alias("bill_rate"),
            F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / q).cast("double").alias("cost_rate"),
            F.when(F.col("l_linestatus") == "O", "Assigned").otherwise("Released").alias("status"),
            ship.alias("start_date"),
            F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("date"))
            .otherwise(F.date_add(ship, (F.col("l_partkey") % 300).cast("int"))).alias("end_date"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        start = F.col("o_orderdate").cast("date")
        return o.where(F.col("o_orderstatus") == "F").select(
            k.alias("contract_id"),
            F.concat(F.lit("CT-"), _s(k)).alias("contract_number"),
            _s(k).alias("project_code"),
            F.concat(F.lit("C"), _s("o_custkey")).alias("company_code"),
            _case(k % 3, [(0, "Fixed Price"), (1, "Time and Materials")], "Retainer").alias("contract_type"),
            F.when(k % 2 == 0, F.col("o_totalprice"))
            .otherwise(F.floor(F.col("o_totalprice") * 9 / 10).cast("double")).alias("contract_value"),
            start.alias("start_date"),
            F.date_add(start, 365).alias("end_date"),
            F.when(k % 4 == 0, "Draft").otherwise("Active").alias("status"),
        )

    @cached_property
    def tickets(self) -> DataFrame:
        e = self.t.events
        v = F.col("value")
        return e.select(
            F.col("event_id").alias("support_id"),
            F.concat(F.lit("C"), _s("user_id")).alias("company_code"),
            F.col("event_type").alias("support_type"),
            F.when(v > 100, "High").when(v > 30, "Medium").otherwise("Low").alias("priority"),
            F.when(F.col("event_id") % 101 == 0, "Escalated")  # outside the allowed statuses
            .otherwise(_case(F.col("event_id") % 4, [(0, "Open"), (1, "In Progress"), (2, "Resolved")], "Closed"))
            .alias("status"),
            F.col("ts").cast("date").alias("reported_date"),
        )

    @cached_property
    def revisions(self) -> DataFrame:
        e = self.t.events
        return e.where(F.col("event_type").isin("view", "click")).select(
            F.col("event_id").alias("revision_id"),
            _s("event_id").alias("project_code"),
            F.col("ts").cast("date").alias("revision_date"),
            F.when(F.col("event_type") == "view", "Scope Change").otherwise("Budget Update").alias("revision_type"),
        )

    @cached_property
    def opportunities(self) -> DataFrame:
        c = self.t.customer
        k = F.col("c_custkey")
        return c.select(
            k.alias("opportunity_id"),
            k.alias("company_id"),
            F.col("c_acctbal").alias("estimated_value"),
            (k % 101).cast("double").alias("probability"),
            _case(k % 5, [(0, "Lead"), (1, "Qualified"), (2, "Proposal"), (3, "Negotiation")], "Closed").alias("stage"),
            F.when(F.col("c_acctbal") < 0, "Lost").otherwise("Active").alias("status"),
        )

    # ------------------------------------------------------------- corpus
    @cached_property
    def pairs(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        n = _s(F.floor(k / 250).cast("bigint"))  # distinct texts grow with the table
        q = F.lit("'")
        kind = k % 6
        query = F.concat(_case(kind, [
            (0, "Show staff of project "), (1, "Find the budget of project "),
            (2, "Count contracts signed this month for company "), (3, "List resources on project today "),
            (4, "Total spend this year per department above ")],
            "Which companies have no contact in group "), n)
        sql = _case(kind, [
            (0, F.concat(F.lit("SELECT s.Role FROM PROJSTAFF s WHERE s.Project_Code = '"), n, q)),
            (1, F.concat(F.lit("SELECT Budget FROM PAC_MNT_PROJECTS WHERE Project_Code = '"), n, F.lit("' LIMIT 1;"))),
            (2, F.concat(F.lit("SELECT COUNT(*) AS n FROM PROJCNTRTS WHERE Company_Code = 'C"), n, q)),
            (3, F.concat(F.lit("SELECT r.Resource_Name FROM PAC_MNT_PROJECTS p JOIN PROJSTAFF s ON p.Project_Code = s.Project_Code "
                               "JOIN PAC_MNT_RESOURCES r ON s.Resource_Code = r.Resource_Code WHERE p.Project_Code = '"), n, q)),
            (4, F.concat(F.lit("SELECT Department, SUM(Actual_Cost) AS spend FROM PAC_MNT_PROJECTS GROUP BY Department "
                               "HAVING SUM(Actual_Cost) > "), n, F.lit(" ORDER BY spend DESC"))),
        ], F.concat(F.lit("SELECT c.Company_Name FROM SRM_COMPANIES c LEFT JOIN SRM_CONTACTS k ON c.Company_ID = k.Company_ID "
                          "WHERE k.Contact_ID IS NULL AND c.Company_ID > "), n))
        reasoning = _case(k % 4, [
            (0, ""), (1, "Filter one table"),
            (2, "Step 1: pick the table. Step 2: filter rows because one project is asked for.")],
            "First find the table, then join on the key column since two tables are needed; finally group.")
        domain = _case(F.col("o_orderstatus"), [("O", "projects"), ("F", "reporting")], "resources")
        return o.select(k.alias("pair_id"), query.alias("query"), sql.alias("sql"),
                        reasoning.alias("reasoning"), domain.alias("domain"))

    @cached_property
    def candidates(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        p = self.pairs.select("pair_id", "query", F.col("sql").alias("p_sql"), F.col("reasoning").alias("p_reasoning"))
        j = li.join(p, li.l_orderkey == p.pair_id, "inner")
        return candidate_columns(j)

    @cached_property
    def generations(self) -> DataFrame:
        c = self.candidates
        nl = F.lit("\n")
        text = _case(F.col("cand_id") % 4, [
            (0, F.concat(F.lit("<think>"), nl, F.col("reasoning"), nl, F.lit("</think>"), nl, nl,
                         F.col("sql"), F.lit("<|im_end|>"))),
            (1, F.concat(F.lit("Here it is:"), nl, F.lit("```sql"), nl, F.col("sql"), nl, F.lit("```"))),
            (2, F.col("sql")),
        ], F.lit("I cannot answer that"))
        return c.select(
            "prompt_id", "cand_id", "expected_sql",
            _case(F.col("prompt_id") % 3, [(0, "Base"), (1, "SFT")], "GRPO").alias("model"),
            F.when(F.col("cand_id") % 97 != 0, text).alias("text"),
            ((F.col("cand_id") % 40).cast("double") / 8).alias("seconds"),
            F.when(F.col("cand_id") % 97 == 0, "timeout").alias("error"),
        )

    # ---------------------------------------------------------------- logs
    @cached_property
    def run_logs(self) -> DataFrame:
        return run_log_columns(self.t.events)

    @cached_property
    def requests(self) -> DataFrame:
        e = self.t.events
        return e.select(
            F.col("event_id").alias("request_id"), F.col("ts"),
            F.concat(F.lit("s"), _s("user_id")).alias("session_id"),
            cache_key(),
            (F.col("value") / 10).alias("latency_s"),
            (F.col("event_type") == "error").alias("failed"),
            ((F.col("event_id") % 11).cast("double") / 10).alias("confidence"),
            _case(F.col("event_id") % 5, [(0, "schema_analysis"), (1, "query_generation"), (2, "validation"),
                                          (3, "reward_evaluation")], "finalize").alias("stage"),
        )
