"""Vectors stored by cells of a k-means partition, searched cell by cell instead of as a whole.

``write`` fits the centres on at most ``SAMPLE`` vectors and puts every vector into the folder of its nearest centre. ``search`` compares a
query with the vectors of its ``probes`` nearest cells. With ``exact``, a second step looks into each further cell that may hold one of the k best:
no vector of a cell is nearer than the distance of its centre less the cell's radius. Without it, the answer is the approximate one of
the first step, as usual for vector stores.

Defined results: vectors that are null or hold a null or non-finite entry are left out, on both sides, and so are queries of another dimension; ties go
to the smaller id. Fewer than k rows are given where there are fewer vectors. An empty table gives an empty index, which finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quillstone.operators import nearest
from quillstone.operators.nearest import usable
from quillstone.operators.ranking import best, small, squared_distance

#: Vectors that the centres are fitted on at most.
SAMPLE, SEED = 50_000, 7


def write(vectors: DataFrame, path: str, cells: int | None = None) -> None:
    """Store vectors (id, embedding and any other columns) below ``path``; by default as many cells as the root of their number."""
    rows = vectors.where(usable(F.col("embedding"))).withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    n = rows.count()
    if n:
        share = min(1.0, 1.2 * SAMPLE / n)
        sample = (rows.sample(share, SEED) if share < 1 else rows).select("features").limit(SAMPLE)
        model = KMeans(k=cells or max(2, round(n**0.5)), seed=SEED, maxIter=10, predictionCol="cell").fit(sample)
        centres = rows.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
        rows = model.transform(rows)
    else:
        centres, rows = rows.sparkSession.createDataFrame([], "cell int, centre array<double>"), rows.withColumn("cell", F.lit(0))
    placed = rows.drop("features").hint("rebalance", "cell")  # a large cell is split by size
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = rows.sparkSession.read.schema(placed.schema).parquet(f"{path}/vectors")
    radius = stored.join(small(centres), "cell").groupBy("cell", "centre").agg(F.sqrt(F.max(squared_distance(F.col("embedding"), F.col("centre")))).alias("radius"), F.count(F.lit(1)).alias("rows"))
    radius.write.mode("overwrite").parquet(f"{path}/cells")


def _cells_of(queries: DataFrame, cells: list, probes: int | None, beyond: int | None) -> DataFrame:
    """(query_id, asked, slab, cells): the cells that a query asks, a row for each slab that holds some.

    ``probes``: its nearest ones. ``beyond``: of those after so many nearest ones, all that may hold a vector within ``bar``; with a null bar all.
    """
    names, slabs = np.array([c.cell for c in cells]), np.array([c.slab for c in cells])
    centres, radii = np.array([c.centre for c in cells]), np.array([c.radius for c in cells])

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for row in pdf.itertuples():
                if len(row.asked) != centres.shape[1]:
                    continue
                far = np.sqrt(((centres - np.asarray(row.asked, dtype=float)) ** 2).sum(1))
                nearest_first = np.lexsort((names, far))
                if beyond is None:
                    wanted = nearest_first[:probes]
                else:
                    wanted = nearest_first[beyond:]
                    wanted = wanted if pd.isna(row.bar) else wanted[far[wanted] - radii[wanted] <= row.bar]
                found += [(row.query_id, row.asked, s, names[wanted[slabs[wanted] == s]]) for s in np.unique(slabs[wanted])]
            yield pd.DataFrame(found, columns=["query_id", "asked", "slab", "cells"])

    out = StructType([queries.schema["query_id"], queries.schema["asked"], StructField("slab", LongType()), StructField("cells", ArrayType(IntegerType()))])
    return queries.mapInPandas(choose, out)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, *, probes: int = 4, exact: bool = True) -> DataFrame:
    """(query_id, id, distance, rank) of queries (query_id, embedding).

    Cells are compared by slabs of about ``nearest.SIDE`` vectors, a query with its cells of the slab only; the centres, as many as the root of
    the number of vectors, go to the tasks.
    """
    asked = queries.where(usable(F.col("embedding"))).select("query_id", F.col("embedding").alias("asked"))
    stored_cells = spark.read.parquet(f"{path}/cells")
    before = F.sum("rows").over(Window.orderBy("cell")) - F.col("rows")
    cells = stored_cells.withColumn("slab", F.floor(before / nearest.SIDE)).collect()
    if not cells:
        return spark.createDataFrame([], StructType([queries.schema["query_id"]]).add("id", "long").add("distance", "double").add("rank", "integer"))
    slabs = spark.createDataFrame([(c.cell, c.slab) for c in cells], "cell int, slab long")
    stored = spark.read.parquet(f"{path}/vectors").join(small(slabs), "cell")
    first = nearest.candidates(stored, _cells_of(asked, cells, probes, None), k, "slab")
    found = best(first, "distance", k, "query_id", descending=False)
    if not exact:
        return found
    found = found.persist()
    # Distances are compared at six places; the bar lies above what rounding may have lowered.
    bars = found.where(F.col("rank") == k).select("query_id", (F.sqrt(F.col("distance") + 1e-6) * (1 + 1e-6)).alias("bar"))
    more = _cells_of(asked.join(bars, "query_id", "left"), cells, None, probes)
    second = nearest.candidates(stored, more, k, "slab")
    return best(found.drop("rank").unionByName(second), "distance", k, "query_id", descending=False)


def work(spark: SparkSession, path: str, queries: DataFrame, probes: int = 4) -> DataFrame:
    """One row: vectors that the first step compares, and those that a whole scan would."""
    cells = spark.read.parquet(f"{path}/cells")
    asked = queries.where(usable(F.col("embedding"))).select("query_id", F.col("embedding").alias("asked"))
    far = squared_distance(F.col("asked"), F.col("centre"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(far, "cell"))
    pairs = asked.join(small(cells), F.size("asked") == F.size("centre")).withColumn("nth", nth)
    return pairs.agg(F.sum(F.when(F.col("nth") <= probes, F.col("rows")).otherwise(0)).alias("compared"), F.sum("rows").alias("scanned"))
