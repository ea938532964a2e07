"""A BM25 index on disk: built once, grown by batches, read for the asked words only.

Four Parquet tables in a folder, each with a folder for every batch:

* ``postings``: scope, term, hits: an array of (id, dl, tf), one row or several for a term; partitioned by a hash of the term
  and sorted by term within files, so that a search reads the folders and row groups of its words. Tasks gather the hits of the documents
  they hold, so a row is shuffled for each term of an Arrow batch and not for each posting;
* ``documents``: scope, id, dl;
* ``vocabulary``: scope, term, df, max_tf, min_dl of the batch; sums, largest and smallest fold over batches;
* ``scopes``: scope, n, words. Written last: a batch counts once it is there, so half a batch is never read.

A batch is written as a whole under its number and replaces what was there under it: a replayed batch changes nothing. ``append``
leaves out ids that other batches hold, so batches that are cut anew after a lost checkpoint do not double a document.

Defined results: a null text has no words and counts as a document; null ids and scopes are values like others; of rows of a batch that share
an id the one of the smallest scope and text counts. An empty batch changes nothing. Long texts are counted within their row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from quillstone.functions import text as T
from quillstone.operators.pool_scores import words_of
from quillstone.operators.ranking import Bm25Index, idf_terms, small
from quillstone.sources.tables import exists

BUCKETS = 64


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted_terms(docs: DataFrame, id_col: str, text_col: str, scope_col: str) -> DataFrame:
    """scope, id, dl, counts: an array of (term, tf) for each document, by sorting its words and measuring the runs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(scope_col).alias("scope"), F.col(id_col).alias("id"), F.sort_array(T.tokens(text)).alias("words"))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    new = lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))
    runs = words.withColumn("starts", F.filter(places, new))
    run = lambda start, n: F.struct(F.get("words", start).alias("term"), (F.coalesce(F.get("starts", n + 1), F.size("words")) - start).cast("long").alias("tf"))
    return runs.select("scope", "id", F.size("words").alias("dl"), F.transform("starts", run).alias("counts"))


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (scope, key, id, text) to (scope, term, hits) of a batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, (dl, flat) = batch.column(1).dictionary_encode(), words_of(batch.column(3))
        key, terms = keys.indices.to_numpy(), flat.dictionary_encode()
        width, doc = max(len(terms.dictionary), 1), np.repeat(np.arange(n), dl)
        found, tf = np.unique((key[doc].astype(np.int64) * width + terms.indices.to_numpy()) * n + doc, return_counts=True)
        group, doc = np.divmod(found, n)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        first = np.unique(key, return_index=True)[1]
        hits = pa.StructArray.from_arrays([batch.column(2).take(pa.array(doc)), pa.array(dl[doc], pa.int32()), pa.array(tf, pa.int64())], ["id", "dl", "tf"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(group)], pa.int32()), hits)
        yield pa.record_batch([batch.column(0).take(pa.array(first[group[starts] // width])), terms.dictionary.take(pa.array(group[starts] % width)), lists], names=["scope", "term", "hits"])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(words_of(batch.column(3))[0], pa.int32())], names=["scope", "id", "dl"])


def _stored(scope: DataType, id_: DataType) -> StructType:
    """Schema of the postings' files."""
    hit = StructType().add("id", id_).add("dl", "integer").add("tf", "long")
    return StructType().add("scope", scope).add("term", "string").add("hits", ArrayType(hit))


def write_batch(docs: DataFrame, path: str, batch: int, *, id_col: str, text_col: str, scope_col: str, buckets: int = BUCKETS) -> None:
    """Write ``docs`` as batch number ``batch`` of the index at ``path``; their ids must be new to it and unique."""
    spark = docs.sparkSession
    at = lambda table: f"{path}/{table}/batch={batch}"
    scope = F.col(scope_col)
    rows = docs.select(scope.alias("scope"), F.to_json(F.struct(scope.alias("scope"))).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = _stored(rows.schema["scope"].dataType, rows.schema["id"].dataType)
    postings = rows.mapInArrow(_hits, kinds).withColumn("bucket", bucket(F.col("term"), buckets))
    # Rebalancing splits the bucket of a frequent word by size.
    dealt = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "scope", "term")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(at("postings"))
    documents = rows.mapInArrow(_lengths, StructType([rows.schema["scope"], rows.schema["id"]]).add("dl", "integer"))
    documents.write.mode("overwrite").parquet(at("documents"))
    written = spark.read.schema(kinds).parquet(at("postings"))
    ends = [F.sum(F.size("hits")).alias("df"), F.max(F.array_max("hits.tf")).alias("max_tf"), F.min(F.array_min("hits.dl")).alias("min_dl")]
    written.groupBy("scope", "term").agg(*ends).write.mode("overwrite").parquet(at("vocabulary"))
    sizes = spark.read.schema(documents.schema).parquet(at("documents")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"))
    sizes.write.mode("overwrite").parquet(at("scopes"))


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete batches: as many as there are folders."""
    if not exists(spark, f"{path}/scopes"):
        return []
    return sorted(r.batch for r in spark.read.parquet(f"{path}/scopes").select("batch").distinct().collect())


def append(docs: DataFrame, path: str, batch: int, *, id_col: str, text_col: str, scope_col: str, buckets: int = BUCKETS) -> None:
    """Add those of ``docs`` whose id no other batch holds, as batch number ``batch``."""
    one = Window.partitionBy("id").orderBy("scope", "text")
    first = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(scope_col).alias("scope"))
    # Only ids are shuffled to find what is repeated or known; texts move where there is such.
    ids, same = first.select("id"), lambda df, c: df.withColumnRenamed("id", c)
    repeated = ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id").persist()
    if not repeated.isEmpty():
        among = small(same(repeated, "repeated"))
        chosen = first.join(among, F.col("id").eqNullSafe(F.col("repeated")), "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
        first = first.join(among, F.col("id").eqNullSafe(F.col("repeated")), "left_anti").unionByName(chosen)
    others = [b for b in batches(docs.sparkSession, path) if b != batch]
    held = None
    if others:
        known = docs.sparkSession.read.parquet(f"{path}/documents").where(F.col("batch").isin(others)).select(F.col("id").alias("known"))
        held = ids.join(known, F.col("id").eqNullSafe(F.col("known")), "left_semi").distinct().persist()
        if not held.isEmpty():
            first = first.join(small(same(held, "known")), F.col("id").eqNullSafe(F.col("known")), "left_anti")
    write_batch(first, path, batch, id_col="id", text_col="text", scope_col="scope", buckets=buckets)
    for found in (repeated, held):
        if found is not None:
            found.unpersist()


def load(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Bm25Index:
    """The index over all complete batches; statistics are folded when they are read."""
    there = F.col("batch").isin(batches(spark, path))
    read = lambda table: spark.read.parquet(f"{path}/{table}").where(there)
    documents = read("documents").select("scope", "id", "dl")
    kinds = _stored(documents.schema["scope"].dataType, documents.schema["id"].dataType).add("bucket", "integer").add("batch", "integer")
    postings = spark.read.schema(kinds).parquet(f"{path}/postings").where(there).select("scope", "term", "bucket", F.inline("hits")).select("scope", "id", "dl", "term", "tf", "bucket")
    scopes = read("scopes").groupBy("scope").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
    folded = read("vocabulary").groupBy("scope", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    return Bm25Index(postings, documents, idf_terms(folded, scopes), scopes, buckets)
