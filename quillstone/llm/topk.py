"""Exact top-k inner-product search by a vector-approximation file.

Components become integers ``floor(scale * x)``. The approximation file holds vectors in blocks, by the number of
each component's cell alone: one byte, ``CELLS`` equal cells between the block's lowest and highest value of that
component. The exact vectors lie in a table of their own.

1. Every query scans the cells. From a cell's lower edge and width follow a lower and an upper bound of the score:
   a product of bytes with the query, in single precision, plus a slack that covers the cells' widths and the
   rounding. The k-th largest lower bound that a task has seen decides which vectors it passes on, and then that of all tasks
   which of those remain.
2. Exact vectors are read in order of the bound: first the ``FIRST * k`` with the highest upper bounds; then, of the rest,
   those whose upper bound still reaches the k-th exact score. No other can be among the k best: the result is exact.

Queries go against all blocks in rounds of at most ``ROUND_VALUES`` components, so what is broadcast has a fixed
size however many queries there are.

Defined results. Vectors that are null or hold a null or non-finite component take no part, as query or candidate.
Vectors only meet vectors of their own length; empty vectors score 0. A query's own row is not returned; other rows of the
same id are, and repeated candidates all count. Every query row has its own ranks, also where ids repeat. Null ids are
candidates like others, after all ids where scores are equal. An empty table gives no rows. Extra columns are ignored.
Scores are 64-bit integers; exact below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch

CELLS = 64
BLOCK = 4096
QUERY_TILE = 128
#: Exact vectors read for a query before the k-th exact score is known, in multiples of k.
FIRST = 4
#: Components of the queries of a round: 32 MB as 64-bit integers.
ROUND_VALUES = 4_000_000
BLOCK_SCHEMA = "dim int, n int, rows binary, low binary, step binary, cells binary"
BOUNDS = pa.schema([("query_row", pa.int64()), ("row", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])
BOUNDS_DDL = "query_row long, row long, lower double, upper double"


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (row, list of longs) to blocks of one dimension each."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("rows", "low", "step", "cells"))])
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def block(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        rows, x = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
        low = x.min(0)
        step = (x.max(0) - low) // CELLS + 1
        cells = ((x - low) // step).astype(np.uint8)
        return pa.RecordBatch.from_pylist([{"dim": dim, "n": len(rows), "rows": rows.tobytes(), "low": low.tobytes(), "step": step.tobytes(), "cells": cells.tobytes()}], schema=schema)

    for batch in batches:
        numbers, lists = batch.column(0).to_numpy(), batch.column(1)
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        lengths = np.diff(offsets)
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            x = flat[offsets[rows][:, None] + np.arange(dim)].astype(np.int64)
            parts = waiting.setdefault(dim, [])
            for k in range(0, len(rows), BLOCK):
                parts.append((numbers[rows[k : k + BLOCK]], x[k : k + BLOCK]))
                if sum(len(a) for a, _ in parts) >= BLOCK:
                    yield block(dim, waiting.pop(dim))
                    parts = waiting.setdefault(dim, [])
    for dim, parts in waiting.items():
        if parts:
            yield block(dim, parts)


def bounds(low: np.ndarray, step: np.ndarray, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, query by vector, from cells alone."""
    weight = queries * step.astype(np.float64)
    inner = weight.astype(np.float32) @ cells.astype(np.float32).T
    rest = (step - 1) * queries  # how far a component may lie above its cell's lower edge, times the query's
    base = queries.astype(np.float64) @ low.astype(np.float64)
    rounding = (len(step) + 4) * 2.0**-22 * np.abs(weight).sum(1) * CELLS + 1e-9 * (np.abs(queries) @ np.abs(low).astype(np.float64)) + 1e-9
    edge = base[:, None] + inner
    return edge + (np.minimum(rest, 0).sum(1) - rounding)[:, None], edge + (np.maximum(rest, 0).sum(1) + rounding)[:, None]


def scan_block(rows: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray, query_rows: np.ndarray, own: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(query row, row, lower, upper) of what may be among the k best; ``floor`` has the k highest lower bounds so far
    of each query, and is raised. ``own`` is each query's own row."""
    k = floor.shape[1]
    for at in range(0, len(queries), QUERY_TILE):
        tile = slice(at, at + QUERY_TILE)
        lower, upper = bounds(low, step, cells, queries[tile])
        itself = rows[None, :] == own[tile][:, None]
        lower[itself], upper[itself] = -np.inf, -np.inf
        best = np.partition(lower, -k, 1)[:, -k:] if len(rows) > k else lower
        floor[tile] = np.sort(np.concatenate([floor[tile], best], 1), 1)[:, -k:]
        q, v = np.nonzero((upper >= floor[tile][:, :1]) & ~itself)
        if len(q):
            yield query_rows[tile][q], rows[v], lower[q, v], upper[q, v]


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale)).alias("q")
    usable = vectors.where(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), whole, F.coalesce(is_query, F.lit(False)).alias("asked"))
    exact = scratch.table("exact", usable.withColumn("row", F.monotonically_increasing_id()))
    blocks = scratch.table("cells", exact.select("row", "q").mapInArrow(_pack_blocks, BLOCK_SCHEMA), "lz4")
    asked = scratch.table("queries", exact.where("asked").select("row", F.col("vec_id").alias("query_id"), "q").withColumn("query_row", F.monotonically_increasing_id()))
    # Rounds: consecutive query rows whose components sum up to the bound at most. The upper bits of a query row are the
    # partition that wrote it, so that ranges never overlap, however files are packed when they are read.
    sized = asked.groupBy(F.shiftright("query_row", 33).alias("part")).agg(F.sum(F.size("q") + 1).alias("values"), F.min("query_row").alias("first"), F.max("query_row").alias("last"), F.count(F.lit(1)).alias("rows"))
    results = None
    for first, last in _rounds(sized.orderBy("first").collect()):
        answers = scratch.table(f"round-{first}", _round(blocks, exact, asked.where(F.col("query_row").between(first, last)), k, scratch, first))
        results = answers if results is None else results.unionByName(answers)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return results


def _rounds(parts) -> Iterator[tuple[int, int]]:
    """Ranges of query rows, each within the bound; a large partition is cut by its mean row size."""
    first = last = None
    values = 0
    for p in parts:
        pieces = -(-p["values"] // ROUND_VALUES)
        if pieces > 1:
            if first is not None:
                yield first, last
                first, values = None, 0
            each = -(-p["rows"] // pieces)
            for at in range(p["first"], p["last"] + 1, each):
                yield at, min(at + each - 1, p["last"])
            continue
        if first is not None and values + p["values"] > ROUND_VALUES:
            yield first, last
            first, values = None, 0
        first = p["first"] if first is None else first
        last, values = p["last"], values + p["values"]
    if first is not None:
        yield first, last


def _round(blocks: DataFrame, exact: DataFrame, asked: DataFrame, k: int, scratch: Scratch, name: int) -> DataFrame:
    by_dim: dict[int, list[tuple[int, int, list[int]]]] = {}
    for r in asked.collect():
        by_dim.setdefault(len(r.q), []).append((r.query_row, r.row, r.q))
    shared = blocks.sparkSession.sparkContext.broadcast({d: tuple(np.array(x, np.int64) for x in zip(*q)) for d, q in by_dim.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                dim, n = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                if dim not in shared.value:
                    continue
                query_rows, own, queries = shared.value[dim]
                raw = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                floor = floors.setdefault(dim, np.full((len(queries), k), -np.inf))
                for found in scan_block(raw(2, np.int64), raw(3, np.int64), raw(4, np.int64), raw(5, np.uint8).reshape(n, dim), query_rows, own, queries, floor):
                    yield pa.record_batch([pa.array(x) for x in found], schema=BOUNDS)

    def kth(rows: DataFrame, column: str) -> DataFrame:
        """The k-th highest of a query's values, for queries that have as many."""
        best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc(column)))).where(F.col("nth") <= k)
        return best.groupBy("query_row").agg(F.min(column).alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("query_row", "least")

    def scored(rows: DataFrame) -> DataFrame:
        both = rows.join(exact.select("row", "vec_id", "q"), "row").join(asked.select("query_row", "query_id", F.col("q").alias("other")), "query_row")
        score = F.aggregate(F.zip_with("q", "other", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        return both.select("query_row", "query_id", "vec_id", "row", score.alias("score"))

    passed = scratch.table(f"bounds-{name}", blocks.mapInArrow(scan, BOUNDS_DDL))
    enough = F.col("least").isNull() | (F.col("upper") >= F.col("least"))
    alive = passed.join(kth(passed, "lower"), "query_row", "left").where(enough).drop("least")
    order = Window.partitionBy("query_row").orderBy(F.desc("upper"), "row")
    alive = scratch.table(f"alive-{name}", alive.withColumn("nth", F.row_number().over(order)))
    first = scratch.table(f"first-{name}", scored(alive.where(F.col("nth") <= FIRST * k)))
    rest = alive.where(F.col("nth") > FIRST * k).join(kth(first, "score"), "query_row", "left").where(enough)
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    every = first.unionByName(scored(rest)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
