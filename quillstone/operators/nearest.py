"""The nearest vectors of each query, by blocks: matrix products instead of one expression for each pair.

``candidates`` deals vectors and queries over a grid by hashes of their ids, blocks of about ``SIDE`` rows on both sides, and each
group of the grid compares one block of vectors with one of queries. A matrix product bounds all distances of the group; the few that may be
among the k best get the exact one, summed component by component in double precision as ``ranking.squared_distance`` does. So a group's
memory is bounded whatever the tables hold, and only about k rows of each query leave it.

Defined results: rows without a usable vector (null, empty, null or non-finite entries) take no part, and a query meets vectors of its own
dimension only. Rows whose scope is null meet none, as in an equality join.
"""

from __future__ import annotations

from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

#: Rows of a block, on both sides of the grid; queries of a block that are multiplied at once.
SIDE, AT_ONCE = 4096, 256
#: More than rounding to six places can move a distance.
ROUNDED = 1.1e-6


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))


def _matrix(column: pa.ChunkedArray, size: int, rows: np.ndarray) -> np.ndarray:
    return column.take(pa.array(rows)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _undominated(distances: np.ndarray, ids: list, k: int) -> list[int]:
    """Places of those that fewer than k others precede in both distance and id, whatever the rounding."""
    keys = [(i is not None, i) for i in ids]
    ranked, kept, heap = sorted(range(len(ids)), key=lambda p: (distances[p], keys[p])), [], []
    order = {key: n for n, key in enumerate(sorted(set(keys)))}
    for p in ranked:
        place = order[keys[p]]
        if len(heap) < k:
            heappush(heap, -place)
        elif place < -heap[0]:
            heapreplace(heap, -place)
        else:
            continue
        kept.append(p)
    return kept


def _block(ids: pa.ChunkedArray, vectors: np.ndarray, asked: np.ndarray, k: int, allowed: np.ndarray | None) -> tuple[list, list, list]:
    """(places of queries, places of vectors, exact distances) that hold the k best of each query."""
    norms, found = (vectors**2).sum(1), ([], [], [])
    for begin in range(0, len(asked), AT_ONCE):
        part = asked[begin : begin + AT_ONCE]
        own = (part**2).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = norms[None, :] + own[:, None] - 2 * (part @ vectors.T)
        sure = np.ones(bound.shape, bool) if allowed is None else allowed[begin : begin + AT_ONCE]
        if not np.isfinite(bound).all():  # components so large that squares overflow: all are compared exactly
            near = sure
        else:
            bound = bound if allowed is None else np.where(sure, bound, np.inf)
            kth = np.partition(bound, k - 1, axis=1)[:, k - 1] if vectors.shape[0] > k else np.full(len(part), np.inf)
            slack = 8e-16 * (vectors.shape[1] + 8) * (norms.max() + own)
            near = sure & (bound <= (kth + ROUNDED + 2 * slack)[:, None])
        of, at = np.nonzero(near)
        exact = np.zeros(len(of))
        with np.errstate(over="ignore"):
            for c in range(vectors.shape[1]):
                gap = vectors[at, c] - part[of, c]
                exact += gap * gap
        starts = np.searchsorted(of, np.arange(len(part) + 1))
        if (np.diff(starts) > k).any():
            kept = []
            for a, b in zip(starts[:-1], starts[1:]):
                kept.extend(range(a, b) if b - a <= k else [a + p for p in _undominated(exact[a:b], ids.take(pa.array(at[a:b])).to_pylist(), k)])
            of, at, exact = of[kept], at[kept], exact[kept]
        for out, new in zip(found, (of + begin, at, exact)):
            out.append(new)
    return found


def _compare(k: int, schema: pa.Schema):
    def compare(stored: pa.Table, asked: pa.Table) -> pa.Table:
        pieces, lengths, wanted = [], pc.list_value_length(stored["embedding"]).to_numpy(), pc.list_value_length(asked["asked"]).to_numpy()
        for size in set(lengths) & set(wanted):
            rows, whose = np.flatnonzero(lengths == size), np.flatnonzero(wanted == size)
            allowed = None
            if "cells" in asked.column_names:
                cell = stored["cell"].to_numpy()[rows]
                names, place = np.unique(cell, return_inverse=True)
                asks = np.zeros((len(whose), len(names)), bool)
                for n, cells in enumerate(asked["cells"].take(pa.array(whose)).to_pylist()):
                    asks[n] = np.isin(names, cells)
                allowed = asks[:, place]
            ids = stored["id"].take(pa.array(rows))
            of, at, exact = (np.concatenate(x) for x in _block(ids, _matrix(stored["embedding"], size, rows), _matrix(asked["asked"], size, whose), k, allowed))
            pieces.append(pa.table([asked["query_id"].take(pa.array(whose[of])), ids.take(pa.array(at)), pa.array(exact)], schema=schema))
        return pa.concat_tables(pieces) if pieces else schema.empty_table()

    return compare


def _dealt(rows: DataFrame, key: str, own: str, copies: str, by: list[str], columns: list[str]):
    """Each row in its block, and once for each block of the other side, grouped by block; names are the side's own."""
    spots = {own: F.pmod(F.xxhash64(key), F.col(own)), copies: F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1))}
    groups = {f"{own}_{c}": F.col(c) for c in by} | {f"{own}_{c}": spots[c] for c in ("v_block", "q_block")}
    return rows.select(*columns, *[c.alias(name) for name, c in groups.items()]).groupBy(*groups)


def candidates(vectors: DataFrame, queries: DataFrame, k: int, *by: str) -> DataFrame:
    """(query_id, id, distance), squared L2, that hold the k best of each query within the columns ``by``.

    ``vectors`` has id and embedding, ``queries`` query_id and asked. Where queries also have ``cells``, an array, they meet vectors of
    these ``cell`` only.
    """
    def number(rows: DataFrame, column: str) -> DataFrame:
        plain = F.col(column) if rows.schema[column].dataType in (ArrayType(FloatType()), ArrayType(DoubleType())) else F.col(column).cast("array<double>")
        return rows.withColumn(column, plain).where(usable(F.col(column))).where(" AND ".join(f"`{c}` IS NOT NULL" for c in by) or "true").withColumn("_", F.lit(0))

    v, q, keys = number(vectors, "embedding"), number(queries, "asked"), ["_", *by]
    blocks = lambda rows, out: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SIDE).alias(out))
    grid = blocks(v, "v_block").join(blocks(q, "q_block"), keys).persist()
    placed = _dealt(v.join(grid, keys), "id", "v_block", "q_block", keys, ["id", "embedding", *(["cell"] if "cells" in q.columns else [])])
    asked = _dealt(q.join(grid, keys), "query_id", "q_block", "v_block", keys, [c for c in ("query_id", "asked", "cells") if c in q.columns])
    out = StructType([StructField("query_id", q.schema["query_id"].dataType), StructField("id", v.schema["id"].dataType), StructField("distance", DoubleType())])
    arrow = pa.schema([pa.field("query_id", _arrow(q, "query_id")), pa.field("id", _arrow(v, "id")), pa.field("distance", pa.float64())])
    return placed.cogroup(asked).applyInArrow(_compare(k, arrow), out)


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)
