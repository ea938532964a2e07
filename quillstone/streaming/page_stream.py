"""Page context of lines that arrive out of order: a section is labelled once it is complete.

Lines land in a folder with their section, number and time of arrival. Repeats are dropped within the watermark; the lines of a section
are kept in state until none has come for ``gap`` and the watermark, ``delay`` behind the latest arrival, has passed that. Then the section
goes through the batch operator as a whole, so the result is what a batch over all lines gives. State holds open sections only.

A batch is written under its number and replaces what a broken-off attempt left. Lines that come later than the watermark allows are
dropped and counted by Spark (``numRowsDroppedByWatermark`` in the progress); a section that goes on after its gap starts anew. Sections still open
at the end of a run stay in the checkpoint's state for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.operators import lines

LANDED = "section_id long, line_no int, line string, landed timestamp"


def complete_sections(landed: DataFrame, delay: str, gap: str) -> DataFrame:
    """section_id and text of sections that are complete; works on a stream and on a batch."""
    once = landed.withWatermark("landed", delay).dropDuplicatesWithinWatermark(["section_id", "line_no"]) if landed.isStreaming else landed.dropDuplicates(["section_id", "line_no"])
    whole = once.groupBy("section_id", F.session_window("landed", gap)).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    return whole.select("section_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n", "").alias("text"))


def page_stream(spark: SparkSession, landing: str, output: str, checkpoint: str, *, delay: str = "1 hour", gap: str = "30 minutes", max_files: int = 100) -> StreamingQuery:
    """Label what is complete of the Parquet that landed, and stop when nothing is left."""
    stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).parquet(landing)

    def write(batch: DataFrame, number: int) -> None:
        lines.classify(batch, "section_id", "text").write.mode("overwrite").parquet(f"{output}/batch={number}")

    return complete_sections(stream, delay, gap).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
