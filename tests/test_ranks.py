"""Numbers and quantiles by ranges against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import ranks


def table(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None] + [rng.randint(-50, 5000)] * 20)) for i in range(800)]
    return rows, spark.createDataFrame(rows, "id long, g string, v int").repartition(5)


@pytest.mark.parametrize("n", [1, 7, 256])
def test_numbers(spark, n):
    rows, df = table(spark)
    got = {(r.g, r.id): r.n for r in ranks.numbered(df, ["g"], "id", "n", n=n).collect()}
    for g in ("hot", "a", None):
        ids = sorted(i for i, x, _ in rows if x == g)
        assert [got[g, i] for i in ids] == list(range(1, len(ids) + 1))


def test_numbers_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(i, "x", None if i % 5 == 0 else i % 4) for i in range(40)], "id long, g string, v int")
    got = [r.id for r in ranks.numbered(df, ["g"], "v", "n", "id", n=3).orderBy("n").collect()]
    assert got == sorted(range(40), key=lambda i: (i % 5 > 0, i % 4 if i % 5 else 0, i))


@pytest.mark.parametrize("n", [1, 7, 256])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles(spark, n, by):
    rows, df = table(spark)
    shares = {"low": 0.1, "mid": 0.5, "top": 0.9, "end": 1.0}
    for r in ranks.quantiles(df, "v", by, shares, n=n).collect():
        own = [v for _, g, v in rows if v is not None and (not by or g == r.g)]
        assert [r.low, r.mid, r.top, r.end] == pytest.approx(list(np.quantile(own, list(shares.values()))))


def test_empty_tables_and_groups_of_nulls(spark):
    df = spark.createDataFrame([("x", None)], "g string, v int")
    assert ranks.quantiles(df, "v", ["g"], {"mid": 0.5}).count() == 0
    assert ranks.numbered(df.limit(0).withColumn("id", F.lit(1)), ["g"], "id", "n").count() == 0
    only = ranks.numbered(df, ["g"], "v", "n").collect()
    assert [(r.g, r.n) for r in only] == [("x", 1)]
