"""Extraction and repair on hand-written model outputs."""

from pyspark.sql import functions as F

from tessera.functions import textfix as TF
from tessera.operators import textops as O


def test_split_output_think_block(spark):
    df = spark.createDataFrame([("<think>\nfind table\n</think>\n\nSQL: SELECT 1 FROM t<|im_end|>",)], "text string")
    r = O.split_outputs(df).first()
    assert r["out_reasoning"] == "find table"
    assert r["out_sql"] == "SELECT 1 FROM t"


def test_extract_sql_fence_and_block(spark):
    df = spark.createDataFrame([("Here:\n```sql\nSELECT a FROM t\n```",),
                                ("Answer below\nselect a\nfrom t;\nthanks",),
                                ("I cannot answer that",)], "text string")
    got = [r["extracted_sql"] for r in O.extract_sql(df).collect()]
    assert got == ["SELECT a FROM t", "select a\nfrom t;", ""]


def test_repair_report(spark):
    df = spark.createDataFrame([("SELECT project_code FROM projects p JOIN staff s ON p.x = s.x", "show projects")],
                               "sql string, query string")
    r = O.repair_report(df).first()
    assert r["processed_sql"] == "SELECT Project_Code FROM PAC_MNT_PROJECTS p JOIN PROJSTAFF s ON p.x = s.x"
    assert r["was_corrected"] and r["uses_domain_tables"]
    assert len(r["corrections"]) == 3
    assert abs(r["confidence"] - 0.7) < 1e-9


def test_fix_from_question(spark):
    df = spark.createDataFrame([("SELECT * FROM things", "list all contracts")], "sql string, query string")
    r = df.select(TF.fix_from_question(F.col("sql"), F.col("query"))["sql"].alias("s")).first()
    assert r["s"] == "SELECT * FROM PROJCNTRTS"


def test_distinct_texts_give_every_row_its_result(spark):
    texts = ["<think>a</think> SELECT 1 FROM t", "```sql\nSELECT 2 FROM u;\n```", None, "", "no query", "SELECT 3 FROM v"]
    df = spark.createDataFrame([(k, texts[k % len(texts)], "Q: ") for k in range(60)], "id int, text string, prompt string")
    for work in (O.split_outputs, O.extract_sql, lambda d, **k: O.extract_after_prompt(d, "text", "prompt", **k)):
        once = sorted((tuple(r) for r in work(df).collect()), key=repr)
        each = sorted((tuple(r) for r in work(df, dedupe=False).collect()), key=repr)
        assert once == each and len(once) == 60 and work(df).columns == work(df, dedupe=False).columns
