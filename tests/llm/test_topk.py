import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import topk
from quillstone.llm.topk import top_k

SCHEMA = "score string, vec_id long, embedding array<float>, rank int"


def brute(rows, k=5):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for _, i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (qi, q) in enumerate(usable):
        if qi is not None and qi % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for row, (i, v) in enumerate(usable) if row != own and len(v) == len(q))[:k]
            out += [(qi, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(best)]
    return sorted(out, key=repr)


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("x", i, rng.normal(0, 0.2, 12).astype(np.float32).tolist(), 1) for i in range(n)]
    rows += [("x", n + j, rows[j % 3][2], 1) for j in range(30)]  # repeated vectors: ties
    rows += [("x", 1000, None, 1), ("x", 1050, [None] * 12, 1), ("x", 1100, [float("nan")] * 12, 1), ("x", 1150, [float("inf")] + [0.0] * 11, 1), ("x", None, [0.5] * 12, 1)]
    return rows + [("x", 2000, [9.0, 1.0], 1), ("x", 2001, [1.0, 1.0], 1), ("x", 2050, [], 1), ("x", 2051, [], 1)]


@pytest.mark.parametrize("n", [0, 3, 700])
def test_matches_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(topk, "ROUND_VALUES", 60)  # several rounds
    rows = rows_of(n) if n else []
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect()), key=repr)
    assert got == brute(rows)


def test_repeated_ids(spark):
    rows = [("x", 0, [1.0, 0.0], 1), ("x", 0, [0.0, 1.0], 1), ("x", 7, [0.5, 0.25], 1), ("x", 7, [0.5, 0.25], 1)]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()))
    # A query's own row is left out, the other row of its id is not.
    assert got == sorted([(0, 1, 7, 128 * 256), (0, 2, 7, 128 * 256), (0, 3, 0, 0), (0, 1, 7, 64 * 256), (0, 2, 7, 64 * 256), (0, 3, 0, 0)])


def test_large_components_stay_exact(spark):
    rows = [("x", i, [float(2**20 + 3 * i), -float(2**19 - i)], 1) for i in range(60)]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("scale", [30, 3000, 2**24])
def test_bounds_hold_the_scores(scale):
    rng = np.random.default_rng(scale)
    for dim in (0, 1, 7, 200):
        x, q = (rng.integers(-scale, scale, (n, dim)) for n in (50, 9))
        low = x.min(0)
        step = (x.max(0) - low) // topk.CELLS + 1
        lower, upper = topk.bounds(low, step, ((x - low) // step).astype(np.uint8), q)
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()


def test_few_exact_vectors_are_read(monkeypatch):
    """The cells leave few of many vectors to be read exactly."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 32, (4000, 64))).astype(np.int64)
    low = x.min(0)
    step = (x.max(0) - low) // topk.CELLS + 1
    floor = np.full((20, 5), -np.inf)
    found = list(topk.scan_block(np.arange(4000), low, step, ((x - low) // step).astype(np.uint8), np.arange(20), np.arange(20), x[:20], floor))
    assert sum(len(f[0]) for f in found) < 20 * 4000 * 0.05


@pytest.mark.parametrize("values", [topk.ROUND_VALUES, 200])
def test_all_queries_answered_from_many_files(spark, values, monkeypatch):
    """Far more files than cores; Spark reads several at once, ordered by size: here the first and the last together."""
    monkeypatch.setattr(topk, "ROUND_VALUES", values)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 40, (820, 4))
    rows = [(i, (v / 256).tolist(), (40, 0, 1 + i % 39)[i % 3]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int").repartitionById(41, "part")
    got = sorted(map(tuple, top_k(df.drop("part"), F.lit(True), k=2).collect()))
    scores = vectors @ vectors.T
    best = [(q, sorted((-s, i) for i, s in enumerate(scores[q].tolist()) if i != q)[:2]) for q in range(len(vectors))]
    assert got == [(q, r + 1, i, -s) for q, found in best for r, (s, i) in enumerate(found)]
