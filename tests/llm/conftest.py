import pytest

SF = "/root/testdata/sf0.001"

#: Columns that clash with names used inside the operators.
CLASHES = ["spans", "mark", "keys", "rep", "size", "survivor", "component_id", "kept", "score", "ids", "border", "part",
           "_gone", "_again", "x", "hits"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _messy_rows():
    long = " ".join(f"word{k % 997} item{k}" for k in range(40_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    return [
        (1, base), (2, base), (2, base),                     # equal texts; a repeated row
        (3, None), (4, ""), (5, "   \n\t "),                 # null, empty, white space only
        (None, base), (None, None), (None, "alone here"),    # no id
        (6, long), (7, long + " end"),                       # very long, near copies
        (8, "a"), (9, "Ünïcödé 日本語 \U0001F600 \x00   x"),
        (10, "password = \"abcdefgh12345678\" mail a.b@c.example.com released under the mit license"),
        (11, "same id, one text"), (11, "same id, another text"),
    ]


@pytest.fixture(scope="session")
def messy_rows():
    return _messy_rows()


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    names = ", ".join(f"{c} string" for c in CLASHES)
    rows = [(i, t, "en", "s", None if t is None else len(t), *["?"] * len(CLASHES)) for i, t in messy_rows]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark, messy):
    return spark.createDataFrame([], messy.schema)
