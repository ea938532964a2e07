"""Whitening of embeddings: leading eigenvectors of their covariance by a randomised range finder, and every vector projected on them.

1. Usable vectors become integers; each distinct integer vector counts once in the fit (``fit list``, a written table).
2. One pass gives the size n of the list and its exact sums S by dimension.
3. Range finder: the centred list is multiplied with ``components + OVERSAMPLING`` random directions, and again with the
   orthonormal result in each of ``POWER_PASSES`` passes. A pass reads the whole list; a task gives one small matrix, Spark adds them by cell.
4. Rayleigh-Ritz: eigenvectors of the covariance within that range. Each must be known to ``TOLERANCE`` (its residual over the
   distance to the next Ritz value bounds the error of its direction); else the range is expanded to all dimensions, one more pass, where Rayleigh-Ritz is exact.
5. A pass over the list gives the whole variance and measures how far the covariance of the whitened vectors is from the identity.

The driver and each task hold matrices of dimension times range, whatever the number of rows.

Defined results. Vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another length than the
most frequent one (of equally frequent ones the shortest). Entries are held at 4e18 either way. Equal vectors count once in the fit and each get their rows; null
ids are kept. Eigenvalues below 1e-11 of the largest count as zero and have no component, so a list of fewer than two distinct vectors,
or an empty table, gives no rows. A component's largest entry is positive. A deviation beyond 64 bits is null. Long vectors cost their length times the range in memory.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch

COMPONENTS, OVERSAMPLING, POWER_PASSES, SEED = 16, 8, 2, 20_251
#: Error of an eigenvector's direction that the range finder may leave.
TOLERANCE = 1e-12
#: Eigenvalues below this part of the largest are zero to double precision.
LEAST_PART = 1e-11
MOST = 4e18


def integers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry c, as longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(64 * c.cast("double"), F.lit(MOST)), F.lit(-MOST))) + F.lit(1_000_000).cast("long"))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x of the rows that take part, of any length."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return own.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", fine)).select("vec_id", integers(F.col("vector")).alias("x"))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """The vectors of a batch, a row each, as longs."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


@dataclass
class Centre:
    """n, exact sums by dimension and the largest entry: what centring needs."""

    n: int
    sums: list[int]
    most: int

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64 bits where they hold it, else Python's integers."""
        if 2 * self.n * max(self.most, 1) < 2**63:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.exact(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n * x - S) ** 2 of each row, null beyond 64 bits."""
        apart = self.exact(x)
        if apart.dtype != object and (not apart.size or int(np.abs(apart).max()) ** 2 * x.shape[1] < 2**63):
            return pa.array((apart * apart).sum(axis=1), pa.int64())
        totals = (apart.astype(object) ** 2).sum(axis=1)
        return pa.array([int(t) if t < 2**63 else None for t in totals], pa.int64())


def _moments(fit: DataFrame, dim: int) -> Centre:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, "x", dim)
                columns = [np.arange(dim, dtype=np.int32), np.full(dim, len(x)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.abs(x).max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "n", "high", "low", "most"])

    parts = fit.mapInArrow(run, "place int, n long, high long, low long, most long")
    found = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("most").alias("most")).orderBy("place").collect()
    return Centre(found[0].n, [(r.high << 32) + r.low for r in found], max(r.most for r in found))


def _summed(fit: DataFrame, shape: tuple[int, int], dim: int, give) -> np.ndarray:
    """Sum over the fit list of the matrices that ``give`` makes of blocks of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = give(_matrix(batch, "x", dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    cells = fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape(shape)


def _covariance(fit: DataFrame, centre: Centre, dim: int, range_: np.ndarray | None) -> np.ndarray:
    """Covariance of the list times ``range_`` (the whole covariance for None)."""
    def give(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        return c.T @ (c if range_ is None else c @ range_)

    return _summed(fit, (dim, dim if range_ is None else range_.shape[1]), dim, give) / centre.n


def _rayleigh_ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values by falling size, their vectors and the norms of the residuals; ``image`` is the covariance times ``basis``."""
    inner = basis.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def _settled(values: np.ndarray, residuals: np.ndarray, components: int) -> bool:
    """Whether the first vectors are known to ``TOLERANCE``."""
    gaps = np.abs(values[:, None] - values[None, :]) + np.diag(np.full(len(values), np.inf))
    return bool((residuals[:components] <= TOLERANCE * gaps.min(axis=1)[:components]).all())


def _components(fit: DataFrame, centre: Centre, dim: int, components: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Eigenvalues by falling size, eigenvectors as columns, and where they were found."""
    width = components + OVERSAMPLING
    if width < dim:
        image = _covariance(fit, centre, dim, np.random.default_rng(SEED).standard_normal((dim, width)))
        for _ in range(POWER_PASSES):
            basis = np.linalg.qr(image)[0]
            image = _covariance(fit, centre, dim, basis)
        values, vectors, residuals = _rayleigh_ritz(basis, image)
        if _settled(values, residuals, components):
            return values, vectors, "range"
    values, vectors, _ = _rayleigh_ritz(np.eye(dim), _covariance(fit, centre, dim, None))
    return values, vectors, "all dimensions"


@dataclass
class Whitening:
    """A fitted whitening. ``found_in`` says whether the range or all dimensions gave the components."""

    dim: int
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    found_in: str

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)

    def transform(self, vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """vec_id, deviation and the whitened vector of every usable row."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, "x", self.dim)
                z = self.whitened(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), self.centre.deviations(x), lists], ["vec_id", "deviation", "whitened"])

        own = usable(vectors, id_col, vector_col).where(F.size("x") == self.dim)
        return own.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def fit_whitening(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening that all distinct vectors of the table give; None if they have no variance."""
    rows = usable(vectors.select(F.lit(None).cast("long").alias("no_id"), vector_col), "no_id", vector_col)
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "dim").first()
    if lengths is None:
        return None
    dim = lengths.dim
    fit = Scratch(vectors.sparkSession, "whitening").table("fit", rows.where(F.size("x") == dim).select("x").distinct())
    centre = _moments(fit, dim)
    values, basis, found_in = _components(fit, centre, dim, components)
    count = int((values[:components] > LEAST_PART * max(values[0], 0)).sum())
    if not count:
        return None
    values, basis = values[:count], basis[:, :count]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(count)])
    found = Whitening(dim, centre, values, basis, 0.0, 0.0, found_in)

    def moments(x: np.ndarray) -> np.ndarray:
        z = found.whitened(x)
        return np.vstack([z.T @ z, z.sum(axis=0), np.full(count, (centre.centred(x) ** 2).sum())])

    total = _summed(fit, (count + 2, count), dim, moments) / centre.n
    inner, mean, found.trace = total[:count], total[count], float(total[-1, 0])
    found.identity_error = float(np.abs(inner - np.outer(mean, mean) - np.eye(count)).max())
    return found


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    found = fit_whitening(vectors, vector_col=vector_col, components=components)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.array(*(F.lit(float(e / found.trace)) for e in found.values))
    own = found.transform(vectors, id_col=id_col, vector_col=vector_col)
    return own.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(found.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
