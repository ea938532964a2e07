"""The rules are tried once for each line, whatever is built on the label."""

from pyspark.sql import functions as F

from jobs import chunk_table
from quillstone.functions import text as T
from quillstone.operators import lines

TEXT = "\n".join(["Premiums 1,234 5,678", " \t", "7", "", "\x0b8\r", "text", "Segment overview", "2024 2023 2022", "2024 2023 2022 then", "Équité 1,200 (30)", "NET LOSS grew", "\xa0", "12 ", "1234"])


def test_rules_stand_once_in_the_plan(spark):
    docs = spark.createDataFrame([(1, TEXT, "en", "s")], "doc_id long, text string, lang string, source string")
    plan = chunk_table.chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(summary|segment|discussion") == 1


def test_labels_and_blanks(spark):
    rows = spark.createDataFrame([(1, TEXT)], "id long, text string")
    got = {r.line_no: r.label for r in lines.rule_labels(lines.split_lines(rows, "id", "text")).collect()}
    want = {0: "table_row", 2: "footer", 4: "narrative", 5: "narrative", 6: "footer", 7: "footer", 8: "narrative", 9: "table_row", 10: "narrative", 12: "narrative", 13: "narrative"}
    assert got == want


def test_strip_and_blank_of_odd_texts(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(["", " a\t", "\x0b\f\r\n", "a b ", "\xa0a", None])], "k int, s string").orderBy("k")
    got = rows.select(T.strip(F.col("s")), T.rstrip(F.col("s")), T.blank(F.col("s")), T.numbers_of(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("", "", True, []), ("a", " a", False, []), ("", "", True, []), ("a b", "a b", False, []), ("\xa0a", "\xa0a", False, []), (None, None, True, None)]
