"""A training corpus from raw documents: filter, de-duplicate, decontaminate, mix, tokenise.

Every stage works on all rows that the one before kept, and returns the columns of ``documents``; the last one
returns what the token files hold: doc_id, start, n_tokens, ids_crc32, a row for each document it was given.
Stages are written as Parquet and read again, so a lost executor costs a stage at most.

Defined results. A null text counts as empty, is never a near-duplicate or a leak, has no share in the mix and so leaves
there. Null ids are larger than others among near-duplicates and come first in the token files. Of equal rows one
stays, but of those without words all do until the mix. Extra columns are carried to the mix, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.decontam import decontaminate
from quillstone.llm.mixing import schedule
from quillstone.llm.near_dup import keep_one
from quillstone.llm.quality import keep_good
from quillstone.llm.store import Scratch, read_table
from quillstone.llm.token_files import token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; it learns from all labels that match a document."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of five-word shingles, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated as often as their source's target asks for."""
    return schedule(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; what they hold, by document."""
    import public_tokenizers

    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: The classifier's fit and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.table(f"{n}-{name}", stage(spark, docs, sf_dir))
    return docs
