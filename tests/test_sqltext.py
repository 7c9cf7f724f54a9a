"""Column functions over SQL text, checked on hand-written cases."""

import random

from pyspark.sql import functions as F

from tessera.functions import sqltext as T
from tessera.operators import scoring as S


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first()["x"]


def test_normalize_sql_comment_after_collapse(spark):
    # whitespace is collapsed before '--' removal, so the comment eats the rest
    sql = "select a\n-- note\nfrom t;"
    assert one(spark, T.normalize_sql(F.col("s")), s=sql) == "SELECT A"
    assert one(spark, T.normalize_sql(F.col("s")), s='SELECT "x" /* c */ FROM t;;') == "SELECT 'X'  FROM T".replace("  ", "  ")


def test_normalize_sql_eval(spark):
    assert one(spark, T.normalize_sql_eval(F.col("s")), s="  select *\n from t; ") == "SELECT * FROM T"


def test_structure_tables(spark):
    st = T.sql_structure(F.col("s"))
    tables = one(spark, st["tables"], s="SELECT * FROM a JOIN b ON x JOIN c ON y")
    assert tables == ["A", "B", "C"]


def test_complexity_and_cost(spark):
    f = T.sql_features(F.col("s"))
    sql = "SELECT d, COUNT(*) FROM p JOIN s ON p.k = s.k WHERE x IN (SELECT y FROM z) GROUP BY d"
    cx = one(spark, f["complexity"], s=sql)
    # 1 select + 1.5 join + 0.5 where + 0.8 agg + 0.6 group col + 2 subquery-in-where
    assert abs(cx - 6.4) < 1e-9
    assert one(spark, f["cost_class"], s=sql) == "high"


def test_validation_layers(spark):
    df = spark.createDataFrame([("SELECT (Budget FROM PAC_MNT_PROJECTS",),
                                ("SELECT * FROM PROJSTAFF; DROP TABLE PROJSTAFF",),
                                ("SELECT * FROM PAC_MNT_PROJECTS WHERE Status = 'On Hold'",),
                                ("SELECT * FROM PAC_MNT_PROJECTS WHERE Budget < -5",),
                                ("SELECT * FROM UNKNOWN_T",)], "sql string")
    rows = {r["sql"]: r for r in S.validate(df).collect()}
    assert "Unmatched parentheses" in rows["SELECT (Budget FROM PAC_MNT_PROJECTS"]["syntax_errors"]
    sec = rows["SELECT * FROM PROJSTAFF; DROP TABLE PROJSTAFF"]
    assert not sec["security_passed"] and "Multiple SQL statements detected" in sec["security_warnings"]
    # multi-word status values are read whole (and 'On Hold' is allowed)
    assert rows["SELECT * FROM PAC_MNT_PROJECTS WHERE Status = 'On Hold'"]["business_valid"]
    assert "Budget/Cost/Value cannot be negative" in rows["SELECT * FROM PAC_MNT_PROJECTS WHERE Budget < -5"]["business_errors"]
    assert rows["SELECT * FROM UNKNOWN_T"]["schema_errors"] == ["Table 'UNKNOWN_T' not found in schema"]
    for r in rows.values():
        assert 0.0 <= r["confidence"] <= 1.0


def test_reward_components_and_total(spark):
    df = spark.createDataFrame(
        [(1, 1, "Show active projects", "SELECT * FROM PAC_MNT_PROJECTS WHERE Status = 'Active'",
          "Step 1: pick the table because projects are asked for. Step 2: filter on status.",
          "SELECT * FROM PAC_MNT_PROJECTS WHERE Status = 'Active'"),
         (1, 2, "Show active projects", "SELECT * FROM projects", "", "SELECT * FROM PAC_MNT_PROJECTS WHERE Status = 'Active'")],
        "prompt_id long, cand_id long, query string, sql string, reasoning string, expected_sql string")
    rows = {r["cand_id"]: r for r in S.score(df).collect()}
    good, bad = rows[1], rows[2]
    assert good["accuracy_reward"] == 2.0
    assert bad["reasoning_reward"] == -1.5
    for r in rows.values():
        parts = [r[c] for c in ("syntax_reward", "schema_reward", "business_reward", "performance_reward",
                                "reasoning_reward")]
        acc = r["accuracy_reward"] or 0.0
        assert abs(r["total_reward"] - (sum(parts) + (2 * acc if acc != 0 else 0))) < 1e-9
        assert -1.0 <= r["reasoning_reward"] <= 1.0 or r["reasoning_reward"] == -1.5
        assert -4.0 <= r["business_reward"] <= 4.0
    assert good["total_reward"] > bad["total_reward"]


def test_sql_functions(spark):
    from tessera.functions import udfs
    udfs.register_functions(spark)
    r = spark.sql("SELECT tessera_normalize_sql('select a  from t;') AS n, "
                  "tessera_uses_domain_tables('SELECT * FROM PROJSTAFF') AS d").first()
    assert r.n == "SELECT A FROM T" and r.d is True
    from tessera.operators import textops
    texts = spark.createDataFrame([(t,) for t in (
        "<think>x</think>\nSELECT 1;<|im_end|>", "Here:\n```sql\nSELECT a\nFROM t\n```", "no query", "", None,
        "so\nSELECT a FROM t;\nmore", "SQL: SELECT b\n\nend")], "text string")
    got = textops.extract_sql(texts).selectExpr("text", "extracted_sql", "tessera_extract_sql(text) AS called").collect()
    assert all(r.extracted_sql == r.called for r in got)
    r = spark.sql("SELECT tessera_sql_structure('select a from t join u') AS st, "
                  "tessera_complexity_score('select a from t group by f(a, b), c') AS c").first()
    assert r.st.tables == ["T", "U"] and r.st.has_join and abs(r.c - 2.2) < 1e-9


def test_graded_feedback_keeps_everything_unless_told(spark):
    keys = ["total_reward", "syntax_reward", "schema_reward", "business_reward", "performance_reward", "reasoning_reward"]
    c = {k: F.lit(0.0) for k in keys}
    v = {k: F.array(*[F.lit(f"{k}{n}") for n in range(4)])
         for k in ("syntax_errors", "schema_errors", "business_errors", "suggestions")}
    row = spark.range(1).select(T.graded_feedback(c, v).alias("all"), T.graded_feedback(c, v, 2, 1).alias("some")).first()
    assert row["all"][-1] == "Suggestions: suggestions0, suggestions1, suggestions2, suggestions3"
    assert row["some"][1] == "Syntax errors: syntax_errors0, syntax_errors1" and row["some"][-1] == "Suggestions: suggestions0"


def _features(spark, sql):
    d = spark.createDataFrame([(s,) for s in sql], "sql string")
    return [r.asDict() for r in S.validate(d).collect()]


def test_literals_and_comments_name_no_tables(spark):
    rows = _features(spark, [
        "SELECT 'copied FROM backup' AS n FROM PAC_MNT_PROJECTS",
        "SELECT Budget /* FROM a JOIN b */ FROM PAC_MNT_PROJECTS -- JOIN c LIMIT 5",
        "-- it's FROM x\nSELECT Budget FROM PAC_MNT_PROJECTS WHERE Note = 'it''s -- GROUP BY x' LIMIT 3",
        "SELECT Budget FROM PAC_MNT_PROJECTS WHERE Note = '/* ' AND Budget > 1 AND Other = ' */ LIMIT 9'",
        "SELECT Budget FROM PAC_MNT_PROJECTS WHERE Note = 'never closed"])
    assert [r["tables"] for r in rows] == [["PAC_MNT_PROJECTS"]] * 5
    assert all(r["schema_errors"] == [] and r["join_tables"] == [] for r in rows)
    assert [r["limit_value"] for r in rows] == [None, None, 3, None, None]
    assert [r["has_where"] for r in rows] == [False, False, True, True, True]
    assert all(r["query_type"] == "SELECT" and r["group_by"] == [] for r in rows)


def test_lists_are_cut_at_depth_zero(spark):
    rng = random.Random(3)

    def item(depth):
        if not depth:
            return rng.choice(["ROLE", "A.B", "1", "''"])
        inner = [item(rng.randint(0, depth - 1)) for _ in range(rng.randint(0, 2))] + [item(depth - 1)]
        return f"F{depth}({', '.join(inner)})"

    lists = [[item(rng.randint(0, 10)) for _ in range(rng.randint(1, 5))] for _ in range(200)]
    d = spark.createDataFrame([(", ".join(x), k) for k, x in enumerate(lists)], "sql string, k int")
    got = {r.k: r.x for r in d.select("k", T._items(F.col("sql")).alias("x")).collect()}
    assert got == dict(enumerate(lists))
    odd = spark.createDataFrame([("f(a, b",), ("a), b, c",), ("",), (" , ,",)], "sql string")
    assert [r.x for r in odd.select(T._items(F.col("sql")).alias("x")).collect()] == [["f(a, b"], ["a)", "b", "c"], [], []]
    errors = _features(spark, ["SELECT F(G(H(Role, 1), 2), 3), COUNT(*) FROM PROJSTAFF WHERE 1 = 1 GROUP BY F(G(H(Role, 1), 2), 3)"])
    assert errors[0]["aggregation_errors"] == [] and errors[0]["select_items"] == ["F(G(H(ROLE, 1), 2), 3)", "COUNT(*)"]
