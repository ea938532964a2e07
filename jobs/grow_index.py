"""Incremental job: documents that landed since the last run enter the BM25 index.

    python -m jobs.grow_index --tables DIR --output DIR --checkpoint DIR [--config jobs/grow_index.json]

A file stream over ``DIR/documents.parquet`` (a folder that files are added to) takes what is new, in batches of at most ``max_files``
files, and ends when nothing is left; the checkpoint remembers the files. Each batch is written to the index under its number, which
replaces what a broken-off attempt left, and ids that are in the index already are left out. So repeated runs change nothing, and
the statistics equal those of an index built at once (``quillstone.operators.term_index``; partitioned by batch and by a hash of the term).

Scopes are the languages, a missing one included. Rows with null text count as documents without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import log, main
from quillstone.operators import term_index

SETTINGS = {"max_files": 64, "buckets": term_index.BUCKETS}
KEYS = {"id_col": "doc_id", "text_col": "text", "scope_col": "scope"}


def run(spark: SparkSession, tables: str, output: str, checkpoint: str, *, max_files: int = 64, buckets: int = term_index.BUCKETS) -> dict[str, int]:
    """Add new documents to the stored index."""
    path = f"{tables}/documents.parquet"
    schema = spark.read.parquet(path).schema
    counts = {"documents": 0, "batches": 0}

    def add(batch: DataFrame, number: int) -> None:
        term_index.append(batch.withColumn("scope", F.struct("lang")), output, number, **KEYS, buckets=buckets)
        n = batch.sparkSession.read.parquet(f"{output}/scopes/batch={number}").agg(F.sum("n").alias("n")).first().n or 0
        counts["documents"], counts["batches"] = counts["documents"] + n, counts["batches"] + 1
        log.info("batch %d: %d documents from %s written to %s", number, n, path, output)

    # As a pattern the path may also be a single file; a plain one must be a folder.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{tables}/documents.parque[t]")
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("read %d new documents in %d batches", counts["documents"], counts["batches"])
    return counts


def result(spark: SparkSession, output: str, buckets: int = term_index.BUCKETS) -> DataFrame:
    """Every word of every scope: its statistics, and what the postings hold of it."""
    index = term_index.load(spark, output, buckets)
    held = index.postings.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("occurrences"), F.sum(F.col("id") % 1000).alias("id_sum"))
    joined = index.terms.join(held, ["scope", "term"], "full")
    return joined.select(F.col("scope.lang").alias("scope"), "term", "df", "max_tf", F.col("min_dl").cast("long").alias("min_dl"), F.round("idf", 6).alias("idf"), "postings", "occurrences", "id_sum")


if __name__ == "__main__":
    main(run, SETTINGS, "tables", "output", "checkpoint")
