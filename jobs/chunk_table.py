"""Batch job: cut documents into table and prose chunks, a Parquet table partitioned by language.

    python -m jobs.chunk_table --tables DIR --output DIR [--config jobs/chunk_table.json]

Reads ``DIR/documents.parquet``. Lines are labelled by the rules, footers dropped, and each run of table rows or of prose becomes
a chunk with its text and kind: what retrieval indexes and what reviewers read. Setting ``languages`` limits a run to some of them.

Reruns replace the partitions they produce, as a whole and when all is written (dynamic overwrite), so a run that is repeated or broken
off leaves the same table; partitions of languages that a run has no rows of stay as they are. Rows with null or empty text have no chunks; a
null language is a partition of its own; rows that share an id are cut one by one. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import log, main
from quillstone.functions import text as T
from quillstone.operators import chunking, lines

SETTINGS = {"languages": None, "compression": "zstd"}
COLUMNS = "doc_id long, source string, chunk_no long, kind string, n_lines long, table_rows long, chunk_type string, chunk_nature string, n_chars int, text string, lang string"


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each run of table rows or prose lines of a document."""
    rows = docs.select("doc_id", "text", "lang", "source").withColumn("row", F.monotonically_increasing_id())
    # The number is fixed before anything is dealt by it: each row is cut by itself, whatever ids it shares.
    placed = chunking.line_islands(lines.classify(rows, "row", "text", "doc_id", "lang", "source"))
    whole = placed.groupBy("section_id", "island", "kind", "doc_id", "lang", "source").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line", "label"))).alias("lines"), F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("label") == "table_row").alias("table_rows"), F.count_if(F.col("label") == "narrative").alias("narrative"),
    )
    kinds = chunking.nature(F.col("table_rows"), F.col("narrative"))
    shown = whole.select("doc_id", "source", F.col("island").alias("chunk_no"), "kind", "n_lines", "table_rows", *kinds, T.render_lines(F.col("lines")).alias("text"), "lang")
    return shown.select("doc_id", "source", "chunk_no", "kind", "n_lines", "table_rows", "chunk_type", "chunk_nature", F.length("text").alias("n_chars"), "text", "lang")


def run(spark: SparkSession, tables: str, output: str, *, languages: list[str] | None = None, compression: str = "zstd") -> dict[str, int]:
    """Cut documents into chunks, partitioned by language."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs = docs if languages is None else docs.where(F.col("lang").isin(languages))
    read, wrote = Observation("read"), Observation("wrote")
    made = chunks(docs.observe(read, F.count(F.lit(1)).alias("n"))).observe(wrote, F.count(F.lit(1)).alias("n"))
    # A frequent language is split over files by size.
    made.hint("rebalance", "lang").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy("lang").parquet(output)
    counts = {"documents": read.get["n"], "chunks": wrote.get["n"]}
    log.info("read %d documents from %s, wrote %d chunks to %s", counts["documents"], tables, counts["chunks"], output)
    return counts


def result(spark: SparkSession, output: str) -> DataFrame:
    """The table as it stands."""
    return spark.read.schema(COLUMNS).parquet(output)


if __name__ == "__main__":
    main(run, SETTINGS, "tables", "output")
