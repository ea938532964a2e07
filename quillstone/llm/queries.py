"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.store import read_table


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.decontam import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("doc_key")


def op4_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.substrings import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillstone.llm.token_files import token_files

    return token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.ctw import score_texts

    return score_texts(read_table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.line_runs import line_runs

    found = line_runs(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.quality import score_quality

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), held_out=held_out)


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.near_dup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.exact_dup import exact_duplicates

    return exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from quillstone.llm.oracles import SQL

    return dict(SQL)
