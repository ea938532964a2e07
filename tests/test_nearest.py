"""Vectors by blocks: the same as one comparison for each pair, over several blocks, copies, near ties, scopes and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import nearest, ranking


def pairwise(vectors, asked, *by):
    distances = ranking.vector_distances(vectors, asked, prefilter=by[0] if by else None)
    return ranking.best(distances, "distance", 5, "query_id", descending=False)


def listed(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "distance").collect())


@pytest.fixture()
def vectors(spark):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((700, 12))
    matrix[100:300] = matrix[0]  # copies: ties go to the smaller id
    matrix[300:400] = matrix[1] + rng.standard_normal((100, 12)) * 1e-5  # equal at six places only
    rows = [(int(i), [float(x) for x in v], int(i) % 3) for i, v in zip(rng.permutation(700), matrix)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(3)


def test_blocks_give_what_pairs_give(vectors, monkeypatch):
    monkeypatch.setattr(nearest, "SIDE", 100)
    asked = vectors.where("id % 4 = 0").select(F.col("id").alias("query_id"), "embedding", "label")
    assert listed(ranking.vector_topk(vectors, asked, 5)) == listed(pairwise(vectors, asked))
    assert listed(ranking.vector_topk(vectors, asked, 5, prefilter="label")) == listed(pairwise(vectors, asked, "label"))


def test_a_group_gives_few_rows_for_many_copies(spark, monkeypatch):
    """All copies are equally near; what leaves a block is still about k rows of each query."""
    monkeypatch.setattr(nearest, "SIDE", 1000)
    vectors = spark.range(4000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    asked = vectors.where("id < 40").select(F.col("id").alias("query_id"), F.col("embedding").alias("asked"))
    found = nearest.candidates(vectors, asked, 5)
    assert found.count() == 40 * 4 * 5
    assert {r.id for r in ranking.best(found, "distance", 5, "query_id", descending=False).collect()} == {0, 1, 2, 3, 4}


def test_odd_rows_take_no_part(spark):
    rows = [(1, [0.0, 1.0], "a"), (2, [1e200, 0.0], "a"), (3, None, "a"), (4, [None, 1.0], "a"), (5, [float("nan"), 1.0], "a"), (6, [], "a"), (7, [3.0], "a"), (8, [0.0, 1.0], None), (9, [0.0, 4.0], "b")]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>, scope string")
    asked = vectors.select(F.col("id").alias("query_id"), "embedding", "scope")
    found = listed(ranking.vector_topk(vectors, asked.where("query_id IN (1, 3, 7, 8)"), 5))
    assert [r[:3] for r in found] == [(1, 1, 1), (1, 2, 8), (1, 3, 9), (1, 4, 2), (7, 1, 7), (8, 1, 1), (8, 2, 8), (8, 3, 9), (8, 4, 2)]
    scoped = listed(ranking.vector_topk(vectors, asked, 5, prefilter="scope"))
    assert [r[:3] for r in scoped if r[0] in (1, 8, 9)] == [(1, 1, 1), (1, 2, 2), (9, 1, 9)]
    assert ranking.vector_topk(vectors.limit(0), asked, 5).count() == 0
