"""Readers and writers: filings and sections, the chunk index, ground truth, labelled lines, evaluation output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions import text as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def skip_latest(filings: DataFrame, date: Column, tie: str, most: int) -> DataFrame:
    """``most`` filings by falling date, without the newest."""
    nth = F.row_number().over(Window.orderBy(date.desc(), F.col(tie)))
    top = filings.orderBy(date.desc(), tie).limit(most + 1)  # bounds what the unpartitioned window sees
    return top.withColumn("nth", nth).where("nth > 1")


def sections(filings: DataFrame, name: str, text: str) -> DataFrame:
    """Sections with text: lower-cased name, stripped text."""
    return filings.withColumn(name, F.lower(name)).withColumn(text, T.strip(F.col(text).cast("string"))).where(F.col(text) != "")


def index_rows(chunks: DataFrame, key: Column) -> DataFrame:
    """Rows of the chunk index: an id and non-null metadata; numbers default to 0, strings to empty."""
    numbers, texts = ("year", "table_row_count", "page_number"), ("section", "chunk_nature", "summary", "page_context", "page_section", "page_subsection", "page_subsubsection")
    hybrid = T.hybrid_text(F.col("text"), *[F.col(c) for c in ("summary", "page_context", "page_section")])
    return chunks.select(key.alias("id"), F.col("text").alias("document"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers], *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts], hybrid.alias("hybrid_embedding_text"))


def doc_id(year: Column, section: Column, suffix: Column) -> Column:
    return F.concat_ws("_", year.cast("string"), section, suffix.cast("string"))


def new_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows whose id is not there yet, one for each id."""
    return rows.dropDuplicates(["id"]).join(existing.select("id"), "id", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows has that file or folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def upsert(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Add to the index at ``path``, partitioned by year, what it does not hold.

    With ``batch`` the rows go into a folder of that number, which they replace: a batch that broke off and comes again leaves
    neither half of it nor a row twice. An index is written with numbers or without.
    """
    spark = rows.sparkSession
    known = exists(spark, path)
    if batch is None:
        new = new_rows(rows, spark.read.parquet(path)) if known else rows.dropDuplicates(["id"])
        new.write.mode("append").partitionBy("year").parquet(path)
        return
    whole = StructType([*rows.schema.fields]).add("batch", "integer")  # named, as the batches so far may be empty
    new = new_rows(rows, spark.read.schema(whole).parquet(path).where(F.col("batch") != batch)) if known else rows.dropDuplicates(["id"])
    new.write.mode("overwrite").partitionBy("year").parquet(f"{path}/batch={batch}")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, as the file has them."""
    return spark.read.option("header", True).csv(path)


def labelled(rows: DataFrame) -> DataFrame:
    """(label, line) of a labelled CSV; column names in any case, empty labels dropped, no rows without both columns."""
    names = {c.strip().lower(): c for c in rows.columns}
    if not {"label", "line"} <= names.keys():
        return rows.sparkSession.createDataFrame([], "label string, line string")
    label = F.lower(T.strip(F.coalesce(F.col(names["label"]), F.lit(""))))
    return rows.select(label.alias("label"), F.coalesce(F.col(names["line"]), F.lit("")).alias("line")).where("label <> ''")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return labelled(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


EVAL_COLUMNS = ["year", "variable", "prediction", "ground_truth", "correct", "retrieval_rank", "retrieval_hit", "retrieval_hit_in_supporting_docs"]


def eval_json(cases: DataFrame, summary: DataFrame) -> DataFrame:
    """The lines of one JSON document with the summary and all cases: part, year, variable, json; in order of the first three.

    A case is a line, so nothing is gathered; all but the first case begin with a comma.
    """
    first = cases.agg(F.min(F.struct("year", "variable")).alias("first"))
    body = F.to_json(F.struct(*sorted(cases.columns)), {"ignoreNullFields": "false"})
    own = F.struct("year", "variable")
    lines = cases.join(F.broadcast(first)).select(F.lit(1).alias("part"), "year", "variable", F.when(own == F.col("first"), body).otherwise(F.concat(F.lit(","), body)).alias("json"))
    ends = summary.select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit('{"summary":'), F.to_json(F.struct(*summary.columns), {"ignoreNullFields": "false"}), F.lit(',"cases":[')).alias("json")),
        F.struct(F.lit(2).alias("part"), F.lit("]}").alias("json")),
    )).alias("e")).select("e.part", F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("variable"), "e.json")
    return lines.unionByName(ends)


def write_eval(cases: DataFrame, summary: DataFrame, json_path: str, csv_path: str | None = None) -> None:
    """One JSON file, which a single task sorts and writes line by line, and the cases as CSV."""
    eval_json(cases, summary).repartition(1).sortWithinPartitions("part", "year", "variable").select("json").write.mode("overwrite").text(json_path)
    if csv_path:
        cases.select(*EVAL_COLUMNS).write.mode("overwrite").option("header", True).csv(csv_path)
