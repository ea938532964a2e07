import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import whitening
from quillstone.llm.whitening import fit_whitening, whiten

FOLDER = "/root/testdata/sf0.001"


def brute(rows):
    """By numpy alone: {vec_id: [(deviation, whitened, explained), ...]}, rows of equal ids in order of their deviation."""
    rows = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = ((n * fit - sums) / n).astype(float)
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    keep = [k for k in np.argsort(-e)[:16] if e[k] > 1e-11 * e.max()]
    z = ((n * x - sums) / n).astype(float) @ u[:, keep] / np.sqrt(e[keep])
    return n, [(rows[r][0], int(((n * x[r] - sums) ** 2).sum()), z[r], e[keep] / np.trace(v)) for r in range(len(rows))]


def held(df, rows, tolerance=1e-7):
    n, want = brute(rows)
    by = {}
    for r in df.collect():
        assert r.n == n and r.identity_error <= 1e-4
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained))
    assert set(by) == {(i, d) for i, d, _, _ in want}
    signs = None
    for i, deviation, z, explained in want:
        mine = by[i, deviation]
        assert sorted(mine) == list(range(1, len(z) + 1))
        flat = np.array([mine[k][0] for k in sorted(mine)])
        signs = np.where(np.abs(z) > 1e-3, np.sign(flat[:, 0] * z), 0) if signs is None else np.where(signs == 0, np.sign(flat[:, 0] * z), signs)
        assert np.allclose(flat[:, 0], z * signs, rtol=tolerance, atol=tolerance) and np.allclose(flat[:, 1], explained, rtol=1e-9)


def made(seed, n, scales):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((len(scales), len(scales))))[0]
    return [(i, [float(c) for c in v]) for i, v in enumerate((rng.standard_normal((n, len(scales))) * scales) @ turn + 0.5)]


def test_flat_spectrum_needs_all_dimensions(spark):
    rows = made(1, 400, np.linspace(1, 2, 40))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert fit_whitening(vectors).found_in == "all dimensions"
    held(whiten(vectors), rows)


def test_steep_spectrum_is_found_in_the_range(spark):
    scales = np.concatenate([3.0 ** np.arange(8, -8, -1), np.full(24, 1e-9)])
    rows = made(2, 500, scales * 100)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = fit_whitening(vectors, components=4)
    whole = brute(rows)
    assert found.found_in == "range" and np.allclose(found.values / found.trace, whole[1][0][3][:4], rtol=1e-10)


def test_odd_rows_repeats_and_clashing_columns(spark):
    rows = made(3, 60, np.linspace(1, 3, 5))
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, rows[1][1]), (None, rows[2][1])]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    short = [(300, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit("a"), "component": F.lit(2)})
    df = whiten(vectors)
    assert df.where("vec_id IN (200, 201, 202, 203, 204, 300)").count() == 0
    assert df.where("vec_id = 100").count() == 10 and df.where("vec_id IS NULL").count() == 5
    assert len({(r.component, r.whitened) for r in df.where("vec_id IN (0, 100)").collect()}) == 5
    held(df, [r for r in rows if r[0] is not None] + [(None, rows[2][1])])


def test_few_vectors_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    three = [(1, [1.0, 2.0, 0.0, 1.0]), (2, [2.0, 5.0, 0.0, 1.0]), (3, [0.5, 1.0, 0.25, 1.0])]
    held(whiten(spark.createDataFrame(three, schema)), three)


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 * i, float(i * i), 3.0]) for i in range(20)]
    df = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert df.count() > 0 and df.where("deviation IS NOT NULL").count() == 0
    assert whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")).count() == 2


def test_centre_is_exact_in_both_widths():
    x = np.array([[5, -7], [2, 9], [1, 1]], np.int64)
    narrow, wide = whitening.Centre(3, [8, 3], 9), whitening.Centre(3, [8, 3], 2**62)
    assert (narrow.exact(x) == wide.exact(x)).all() and narrow.deviations(x).to_pylist() == wide.deviations(x).to_pylist()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables are not here")
def test_query_matches_brute_force(spark):
    from quillstone.llm.queries import op12_embedding_whitening

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    held(op12_embedding_whitening(spark, FOLDER), rows)
