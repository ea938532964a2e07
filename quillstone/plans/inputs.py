"""Inputs of the registered queries, derived from the supplied tables in SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

AMOUNT = "concat(CAST(CAST(floor({x} / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor({x}) AS BIGINT) % 1000 AS STRING), 3, '0'))"
A, B, C = AMOUNT.format(x="o_totalprice"), AMOUNT.format(x="(o_custkey * 37 + 1000)"), AMOUNT.format(x="(o_orderkey + 20000)")

#: Lines of financial tables and prose with known shapes, a row for each order.
LINES = f"""
SELECT o_orderkey AS id, o_custkey AS section_id, CASE o_orderkey % 17
  WHEN 0 THEN concat('Revenues$', {A}, ' $', {B})
  WHEN 1 THEN concat('Net Loss (', {A}, ') (', {B}, ')')
  WHEN 2 THEN concat('Equity $', {A})
  WHEN 3 THEN concat('Total revenues ', {A}, ' ', {B}, ' ', {C})
  WHEN 4 THEN concat('Net income was $', {A}, ' million in 2024 and net loss ', {B})
  WHEN 5 THEN '2024 2023 2022'
  WHEN 6 THEN concat('Segment discussion ', o_orderstatus)
  WHEN 7 THEN concat('  rate 0.5% ', {A}, '.25 ', {B}, chr(160), {C}, '  ')
  WHEN 8 THEN ''
  WHEN 9 THEN CAST(o_orderkey % 90 + 1 AS STRING)
  WHEN 10 THEN '   '
  WHEN 11 THEN concat('ITEM ', CAST(o_orderkey % 9 AS STRING), ' | Notes ', o_orderstatus, ' | ', o_orderpriority)
  WHEN 12 THEN concat('AIG | 2024 Form 10-K ', o_orderstatus)
  WHEN 13 THEN 'SUMMARY OF RESULTS'
  WHEN 14 THEN concat('The following table shows results: ', o_orderpriority)
  WHEN 15 THEN concat('Total revenue reached ', {B}, ' billion dollars')
  ELSE concat('Premiums ', {A}, chr(9), '(', {B}, ') $ ', {C}) END AS line
FROM orders"""

#: Sections made of those lines: section_id, year, section, text.
SECTIONS_DUCKDB = f"SELECT section_id, CAST(2021 + section_id % 5 AS INTEGER) AS year, concat('Item ', CAST(section_id % 9 AS STRING)) AS section, string_agg(line, chr(10) ORDER BY id) AS text FROM ({LINES}) GROUP BY section_id"

#: Ranked chunks of cases: documents by language stand for filings of years 2021 to 2024.
YEAR = "CASE lang WHEN 'en' THEN 2021 WHEN 'de' THEN 2022 WHEN 'fr' THEN 2023 ELSE 2024 END"


def rel(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A query over the folder's tables, written with their plain names."""
    for t in TABLES:
        sql = sql.replace(f"FROM {t}", f"FROM parquet.`{folder}/{t}.parquet`").replace(f"JOIN {t} ", f"JOIN parquet.`{folder}/{t}.parquet` ")
    return spark.sql(sql)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return rel(spark, folder, LINES)


def sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = lines(spark, folder).groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("id", "line"))).alias("l"))
    return rows.select("section_id", (2021 + F.col("section_id") % 5).cast("int").alias("year"), F.concat(F.lit("Item "), (F.col("section_id") % 9).cast("string")).alias("section"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
