"""The excerpt splits a text and evaluates the aliases once, however often the rules look at them."""

import re

from pyspark.sql import functions as F

from quillstone.functions import text as T


def test_text_and_aliases_are_evaluated_once(spark):
    rows = spark.createDataFrame([("one\n\ntwo words\nthree table_row", ["words"])], "text string, aliases array<string>")
    found = rows.select(T.value_excerpt(F.col("text"), F.col("aliases")).alias("x"))
    project = found._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert len(re.findall(r"\bsplit\(", project)) == 1 and project.count("aliases#") == 1
    assert found.first().x == "one\ntwo words\nthree table_row"
