"""Evaluation records: the same results with less moved."""

from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import scoring as S
from tessera.operators.textops import extract_sql, split_outputs

TEXTS = [None, "", "I cannot answer that", "SELECT a FROM t", "SQL: SELECT a FROM t;<|im_end|>", "Here:\n```sql\nSELECT b FROM t\n```",
         "<think>\npick the table\n</think>\n\nselect a from t", "<think>only</think>", "<think>why</think>  <|im_end|>", "x\ny select 1"]


def test_rows_are_taken_apart_where_they_lie(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2)], "id int, text string")
    got = E.with_extracted(rows)
    assert got.columns == ["id", "sql", "reasoning"]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # a shared text gathers no rows
    want = split_outputs(extract_sql(rows)).select("id", F.when(F.col("out_sql") == "", F.col("extracted_sql"))
                                                   .otherwise(F.col("out_sql")), "out_reasoning")
    blank = F.coalesce("sql", F.lit("")).alias("sql")  # null texts are made empty by eval_records
    assert sorted(map(tuple, got.select("id", blank, "reasoning").collect())) == sorted(map(tuple, want.collect()))


def test_records_of_rows_that_share_texts(spark):
    rows = [(p, c, "SELECT a FROM t", "m", t, 1.0, None) for p in (1, 2, None) for c, t in enumerate(TEXTS)]
    generations = spark.createDataFrame(rows * 2, "prompt_id int, cand_id int, expected_sql string, model string, text string, "
                                        "seconds double, error string")
    questions = spark.createDataFrame([(1, "show a"), (2, None), (None, "lost")], "prompt_id int, query string")
    got = E.eval_records(generations, questions).collect()
    assert len(got) == 2 * 2 * len(TEXTS)
    by = {(r.prompt_id, r.cand_id): r for r in got}
    assert [by[1, c].is_correct for c in range(len(TEXTS))] == [False, False, False, True, True, False, True, False, False, False]
    assert [by[2, c].has_reasoning for c in range(len(TEXTS))] == [c in (6, 7, 8) for c in range(len(TEXTS))]
    assert by[1, 6].reasoning == "pick the table" and by[1, 0].generated_sql == "" and by[1, 0].reward_score == 0


def test_rows_move_without_their_reasoning(spark):
    rows = spark.createDataFrame([(1, "SELECT a FROM t", "SELECT b FROM t", "Step 1: pick", "show b")],
                                 "prompt_id int, sql string, expected_sql string, reasoning string, query string")
    node = S.score(rows).select("prompt_id", "total_reward")._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    moved = node.children().head().output().toString()
    assert "reasoning_reward" in moved and "reasoning#" not in moved and "query#" not in moved
