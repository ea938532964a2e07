"""Golden values of the line functions."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators.chunking import table_text

GOLDEN = [
    ("Premiums$71,204 $69,980", "Premiums | 71204.0 | 69980.0"),
    ("Change in reserves (812) (1,040)", "Change in reserves | -812.0 | -1040.0"),
    ("Goodwill $44", "Goodwill $44"),
    ("no amounts at all", "no amounts at all"),
    ("Rev 1 2 3 4", "Rev 1 | 2.0 | 3.0 | 4.0"),
    ("Total $ 5,500 $ 4,800", "Total $ | 5500.0 | None | 4800.0"),
    ("A(1)(2)", "A | -1.0 | -2.0"),
    ("Big12345678 9", "Big | 12345678.0 | 9.0"),
    ("Huge 123456789012345678 9", "Huge | 1.2345678901234568e+17 | 9.0"),
]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize(("line", "expected"), GOLDEN)
def test_table_lines(spark, line, expected):
    assert one(spark, line, T.parse_financial_table) == expected
    assert table_text(line) == expected


@pytest.mark.parametrize(
    ("answer", "value", "docs"),
    [
        ('{"value": "BBB+", "supporting_docs": [1]}', "BBB+", [1]),
        ('```json\n{"value": "12", "supporting_docs": [2, 3]}\n```', "12", [2, 3]),
        ("{VALUE: BBB+, SUPPORTING_DOCS: [1]}", "bbb+", [1]),
        ('{"value": null, "supporting_docs": []}', None, []),
        ("{'value': 'x y', supporting_docs: [1, b, 4]}", None, None),
        ("{value: 'x y', supporting_docs: [1, b, 4]}", "x y", [1, 4]),
    ],
)
def test_answers(spark, answer, value, docs):
    got = one(spark, answer, T.parse_json_answer)
    if docs is None:
        assert got is None
    else:
        assert (got.value, got.supporting_docs) == (value, docs)


def test_no_answer(spark):
    assert one(spark, "plain words", T.parse_json_answer) is None
    assert one(spark, "{ VALUE: , SUPPORTING_DOCS: [] }", T.empty_answer)
    assert not one(spark, '{"value": "1", "supporting_docs": []}', T.empty_answer)


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("", "other"), ("2024  2023  2022", "year_header"), ("Segment Results", "header"), ("Total revenues 26,775 27,251 27,938", "table_row"),
        ("Net income (loss)$(1,404)", "single_value"), ("Sales were 1,200 in the period", "narrative"), ("our net income fell sharply", "narrative"), ("10,000 more 20,000", "narrative"), ("words only", "other"), ("TABLE | Equity 1,000 2,000", "table_row"),
    ],
)
def test_rule_types(spark, line, kind):
    assert one(spark, line, T.rule_type) == kind


def test_titles(spark):
    for line, title in [("SEGMENT RESULTS", True), ("Segment Results", True), ("Segment results:", True), ("segment results", False), ("ABC", False), ("One Two Three Four Five Six Seven Eight Nine", False)]:
        assert one(spark, line, T.is_title) is title, line


def test_mentions(spark):
    got = one(spark, "Net income decreased to $3.1 billion in 2024 compared to total revenues of (3,600) million", T.mentions)
    assert [(m.label, m.value, m.year) for m in got] == [("net income", 3100.0, 2024), ("total revenues", -3600.0, None)]


def test_queries(spark):
    row = spark.range(1).select(T.build_queries(F.array(F.lit("A b"), F.lit("total in 2024"), F.lit("one two three four five six seven")), F.lit("base words here"), F.array(F.lit("x")), F.array(F.lit("A b")), F.array().cast("array<string>")).alias("q")).first().q
    assert (row.bm25_query, row.embedding_query) == ("A b", "A b x")
    none = F.array().cast("array<string>")
    row = spark.range(1).select(T.build_queries(none, F.lit("one two three four five six seven"), none, none, none).alias("q")).first().q
    assert (row.bm25_query, row.embedding_query) == ("one two three four five six", "financial statement table value")
