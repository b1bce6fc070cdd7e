"""Plans whose cost per row or memory per task must not come back: lambdas over every amount, sorts and shuffles that one would do."""

from pyspark.sql import functions as F

from grandlivre.functions.amounts import parse_amount, parse_ocr_amount
from grandlivre.operators import observations as O
from grandlivre.operators import ratios as R
from grandlivre.operators import tables as T
from grandlivre.sources.scratch import dealt


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_amounts_take_no_lambda(spark):
    """amounts are read in generated code; a boundary and signs inside noise stay as they were."""
    df = spark.createDataFrame([("1000000000000",), ("1 000 000 000 000,0001",), ("x-12y",), ("5\n0",), ("1,234,56",)], "raw string")
    out = df.select(parse_amount(F.col("raw")).alias("v"), parse_ocr_amount(F.col("raw")).alias("o"))
    assert [(r.v and str(r.v), r.o and str(r.o)) for r in out.collect()] == [("1000000000000.0000", "1000000000000.0000"), (None, None), ("-12.0000", "-12.0000"), ("50.0000", "50.0000"), (None, "1234.5600")]
    assert "lambda" not in plan(out)


def test_table_rows_take_one_window(spark):
    """sections, blocks and heads of tables need one sort; blocks after other lines, and pages, stay apart."""
    text = "Bilan actif\n| Poste | Net | Net |\n|---|---|---|\n| a | 1 | 2 |\nCPC\n| b | c |\n| d | |\n| lone |\n| x |"
    pages = spark.createDataFrame([("d", 1, "ok", text), ("d", 2, "ok", "| h | net |\r\n| e | 5 |")], "document_id string, page_number int, status string, content string")
    out = T.financial_rows(pages)
    got = [(r.page_number, r.row, r.section, r.raw_label, r["values"]) for r in out.orderBy("page_number", "row").collect()]
    assert got == [(1, 3, "BILAN_ACTIF", "a", {"net_n": "2"}), (1, 6, "CPC", "d", {"c": None}), (1, 7, "CPC", "lone", {"c": None}), (1, 8, "CPC", "x", {"c": None}), (2, 1, "CPC", "e", {"net_n": "5"})]
    assert plan(out).count("Window [") == 1


def test_parsed_tables_take_one_window(spark):
    """blocks, heads and row numbers of tables need one sort; empty texts and other lines stay apart."""
    pages = spark.createDataFrame([(1, "x\n|h| a|\n| :--|-|\n |b | c| d |\n\n|k|\n|m|n|\n||o|"), (2, None)], "k int, t string")
    out = T.parse_tables(pages, ["k"], "t")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == [(1, 1, 2, "b", "a", "c"), (1, 1, 2, "b", "col_2", "d"), (1, 2, 1, "m", "col_1", "n")] and plan(out).count("Window [") == 1


def test_tables_are_dealt_by_size(spark):
    """a table larger than the session's tasks should hold gets more of them, with every row once."""
    df = spark.range(1000)
    assert dealt(df, "id", most=10).rdd.getNumPartitions() == 100 and dealt(df, "id", most=10).count() == 1000 and dealt(df, "id") is df


def test_wanted_ratios_alone(spark):
    """values of the wanted ratios come without grades and points, equal to those of the full list."""
    df = spark.createDataFrame([(1, 8.0, 3.0, 2.0, 5.0)], "k int, ca double, rn double, fp double, tb double")
    codes = ["commercial_profitability", "ca_growth", "financial_autonomy"]
    out = R.weighted_values(df, ["k"], codes)
    full = {(r.code, r.value) for r in R.weighted_ratios(df, ["k"]).collect() if r.code in codes}
    assert {(r.code, r.value) for r in out.collect()} == full and len(full) == 3 and "conforme" not in plan(out)


def test_metadata_labels_are_scored_once(spark):
    """labels are scored after they are made distinct; a document without any known label keeps its row."""
    rows = [("a", "reference", "R1", "IDENTIFICATION", 1, 1), ("a", "reference", "R2", "IDENTIFICATION", 2, 2), ("b", "zzz", "x", "AUTRE", 1, 1)]
    obs = spark.createDataFrame(rows, "document_id string, normalized_label string, raw_value string, section string, page int, ordinal long")
    out = O.document_metadata(obs)
    assert sorted((r.document_id, r.reference) for r in out.collect()) == [("a", "R1"), ("b", None)] and "Join LeftOuter" in plan(out)
