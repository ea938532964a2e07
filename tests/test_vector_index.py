"""Vectors by cells against the whole scan: exact on any data, few comparisons and high recall where vectors form clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import ranking, vector_index


def stored(spark, tmp_path, vectors, **options):
    path = f"file://{tmp_path}/cells"
    vector_index.write(vectors, path, **options)
    return path


def frame(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id long, embedding array<float>").repartition(3)


def asked(vectors, every=20):
    return vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "embedding")


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 5)) for r in df.collect())


def test_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = frame(spark, rng.standard_normal((30, 16))[rng.integers(0, 30, 1500)] * 6 + rng.standard_normal((1500, 16)) * 0.3)
    path = stored(spark, tmp_path, vectors, cells=40)
    want = rows(ranking.vector_topk(vectors, asked(vectors), 5))
    assert rows(vector_index.search(spark, path, asked(vectors), 5, probes=2)) == want
    near = rows(vector_index.search(spark, path, asked(vectors), 5, probes=2, exact=False))
    spent = vector_index.work(spark, path, asked(vectors), 2).first()
    assert len(set(near) & set(want)) >= 0.95 * len(want) and spent.compared < 0.1 * spent.scanned
    assert sorted(r.id for r in spark.read.parquet(f"{path}/vectors").select("id").collect()) == list(range(1500))


@pytest.mark.parametrize("probes", [1, 6])
def test_scattered_and_repeated_vectors_are_exact(spark, tmp_path, probes):
    matrix = np.random.default_rng(2).standard_normal((300, 8))
    matrix[100:180] = matrix[0]
    vectors = frame(spark, matrix)
    path = stored(spark, tmp_path, vectors)
    assert rows(vector_index.search(spark, path, asked(vectors), 5, probes=probes)) == rows(ranking.vector_topk(vectors, asked(vectors), 5))


def test_odd_vectors_few_vectors_and_none(spark, tmp_path):
    schema = "id long, embedding array<double>, label int"
    odd = [(1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, None, 3), (4, [None, 1.0], 4), (5, [float("nan"), 1.0], 5), (6, [], 6)]
    vectors = spark.createDataFrame(odd, schema)
    path = stored(spark, tmp_path / "a", vectors)
    queries = spark.createDataFrame([(9, [0.0, 1.0]), (10, None), (11, [1.0])], "query_id long, embedding array<double>")
    assert rows(vector_index.search(spark, path, queries, 5)) == [(9, 1, 1, 0.0), (9, 2, 2, 1.0)]
    empty = stored(spark, tmp_path / "b", vectors.limit(0))
    assert vector_index.search(spark, empty, queries, 5).count() == 0


def test_ties_by_rounding_lie_in_further_cells(spark, tmp_path):
    """A vector whose distance rounds to that of the k-th best counts by its id, also beyond the probed cell."""
    vectors = spark.createDataFrame([(10, [0.0, 0.0]), (1, [5e-4, 0.0])], "id long, embedding array<double>")
    path = stored(spark, tmp_path, vectors, cells=2)
    queries = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert rows(vector_index.search(spark, path, queries, 1, probes=1)) == [(7, 1, 1, 0.0)]
