"""Incremental indexing: landed sections are chunked and appended once, also when a batch is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators.chunking import simple_chunks
from quillstone.sources import tables


def chunk_rows(landed: DataFrame, size: int, overlap: int) -> DataFrame:
    chunks = simple_chunks(landed, "section_id", "text", "year", "section", size=size, overlap=overlap)
    return chunks.select(tables.doc_id(F.col("year"), F.col("section"), F.concat_ws("_", "section_id", "chunk_no")).alias("id"), "year", "section", "text")


def index_stream(spark: SparkSession, landing: str, schema: str, index: str, checkpoint: str, *, size: int = 1000, overlap: int = 100) -> StreamingQuery:
    """Read Parquet that lands in a folder, append unseen chunks to the index, stop when nothing is left."""
    stream = spark.readStream.schema(schema).parquet(landing)

    def append(batch: DataFrame, number: int) -> None:
        tables.upsert(chunk_rows(batch, size, overlap), index, number)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
