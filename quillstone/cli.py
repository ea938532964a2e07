"""Commands: build an index, evaluate, review chunks, pseudo-label lines, train the line classifier.

    python -m quillstone.cli index --filings DIR --index DIR [--chunker table-aware|simple] [--max-chunk-chars N]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as T
from quillstone.operators import chunking, embedding, evaluation, extraction, learning, lines, ranking
from quillstone.sources import tables


def _chunks(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Chunks of filings: Parquet with filing_id, filing_date, section, text. The newest filing is skipped."""
    filings = tables.sections(spark.read.parquet(a.filings), "section", "text")
    by = Window.orderBy(F.col("filing_date").desc())
    nth = filings.select("filing_date").distinct().withColumn("nth", F.row_number().over(by)).where((F.col("nth") > 1) & (F.col("nth") <= a.max_filings + 1))
    kept = filings.join(F.broadcast(nth.select("filing_date")), "filing_date").withColumn("year", F.year("filing_date"))
    # Ids stay the same over runs, so that the index takes a section once; equal sections of a year are one.
    named = kept.withColumn("section_id", F.xxhash64("year", "section", "text")).dropDuplicates(["year", "section", "text"])
    if a.chunker == "simple":
        made = chunking.simple_chunks(named, "section_id", "text", "year", "section", size=a.max_chunk_chars, overlap=a.chunk_overlap_chars)
        plain = {"summary": F.lit(None).cast("string"), "chunk_type": F.lit("narrative"), "chunk_nature": F.lit("narrative_main"), "table_row_count": F.lit(0), "page_number": F.lit(0), **{f"page_{n}": F.lit("") for n in ("context", "section", "subsection", "subsubsection")}}
        return made.withColumns(plain)
    labeller = learning.labeller(learning.load(spark, a.line_model)) if a.line_model else None
    made = chunking.table_aware_chunks(named, "section_id", "text", "year", size=a.max_chunk_chars, overlap=a.chunk_overlap_chars, labeller=labeller)
    return made.join(named.select("section_id", "section").distinct(), "section_id")


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    chunks = _chunks(spark, a)
    key = tables.doc_id(F.col("year"), F.col("section"), F.concat_ws("_", "section_id", "chunk_no"))
    tables.upsert(tables.index_rows(chunks, key), a.index)
    stats = chunking.summary(spark.read.parquet(a.index).withColumnRenamed("document", "text"))
    stats.write.mode("overwrite").json(f"{a.index}/_chunk_stats")  # names that begin with a line are not read as rows
    print(json.dumps(stats.first().asDict(recursive=True)))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """BM25, vectors or both over an index for every ground-truth row and variable, offline extraction, summary."""
    chunks = spark.read.parquet(a.index)
    truth = tables.read_ground_truth(spark, a.eval_path)
    truth = truth.where(F.col("year") == a.year) if a.year else truth
    variables = spark.createDataFrame([(n, al, t) for n, _, al, t in fixed.VARIABLES], "variable string, aliases array<string>, template string")
    none = F.array().cast("array<string>")
    plan = variables.withColumn("q", T.build_queries(F.col("aliases"), F.col("template"), none, none, none)).select("variable", "aliases", "q")
    cases = evaluation.eval_cases(truth, variables).join(F.broadcast(plan), "variable").withColumn("case_id", F.concat_ws("-", "year", "variable"))
    built = ranking.bm25_index(chunks, "id", "document", "year")
    asked = cases.select(F.col("case_id").alias("query_id"), F.col("year").alias("scope"), F.col("q.bm25_query").alias("query"), F.col("q.embedding_query").alias("meant"))
    if a.match_method != "bm25":
        vectors = embedding.embed(chunks.select("id", F.col("year").alias("scope"), "hybrid_embedding_text"), "hybrid_embedding_text").drop("hybrid_embedding_text")
        meant = embedding.embed(asked.select("query_id", "scope", "meant"), "meant").drop("meant")
    if a.match_method == "embedding":
        ranked = ranking.vector_topk(vectors, meant, fixed.TOP_K, prefilter="scope")
    else:
        words = ranking.bm25_normalized(built, asked)
        near = words.select("query_id", "id", F.lit(0.0).alias("distance")).limit(0) if a.match_method == "bm25" else ranking.vector_distances(vectors, meant, prefilter="scope")
        fused = ranking.fuse(words, near, chunks.select("id", "chunk_nature"), table_bonus=a.table_bonus and a.match_method == "hybrid")
        ranked = ranking.hybrid_topk(fused, fixed.TOP_K)
    top = ranked.join(chunks.select("id", "document", "section", "table_row_count", F.col("year").alias("filing_year")), "id")
    joined = top.withColumnRenamed("query_id", "case_id").join(cases.select("case_id", F.col("year").alias("target_year"), "aliases"), "case_id")
    docs = extraction.collect_docs(joined.withColumnRenamed("document", "text"))
    asked = extraction.doc_blocks(docs).join(cases, "case_id").select("case_id", "documents", F.replace("variable", F.lit("_"), F.lit(" ")).alias("target"), "year", "aliases")
    values = extraction.extract_values(asked)
    judged = cases.join(values, "case_id", "left").withColumn("prediction", T.normalize_answer(F.col("variable"), F.col("value")))
    judged = judged.withColumn("correct", T.values_match(F.col("prediction"), F.col("ground_truth")))
    found = docs.join(judged.select("case_id", "ground_truth", "supporting_docs"), "case_id")
    rows = judged.join(evaluation.rank_in_docs(found, "case_id"), "case_id", "left").fillna({"retrieval_rank": -1, "retrieval_hit": False, "retrieval_hit_in_supporting_docs": False})
    rows = rows.select(*tables.EVAL_COLUMNS).persist()
    summary = evaluation.summary(rows)
    tables.write_eval(rows, summary, a.output_path, a.output_summary_path)
    print(json.dumps(summary.first().asDict()))


def review(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunk review rows: id, line_count, char_count, table_rows, text_lines."""
    chunks = _chunks(spark, a)
    lines_ = F.split("text", "\n", -1)
    rows = chunks.select(F.row_number().over(Window.partitionBy("year").orderBy("section_id", "chunk_no")).alias("id"), "year", F.size(lines_).alias("line_count"), F.length("text").alias("char_count"), "table_row_count", lines_.alias("text_lines"))
    rows.write.mode("overwrite").json(a.out)
    header = chunking.review_header(rows.select("char_count"), a.max_filings)
    header.write.mode("overwrite").json(f"{a.out}/_stats")
    print(json.dumps(header.first().asDict(recursive=True)))


def pseudo_label(spark: SparkSession, a: argparse.Namespace) -> None:
    """Label the lines of all CSV files of a folder but those already labelled; a file is a section."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{a.input_dir}/{a.pattern}")
    if "line" not in read.columns:
        raise ValueError("the files must contain a 'line' column")
    rows = read.select("line", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at")).where(~F.col("file").endswith(f"{a.suffix}.csv"))
    texts = rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    labelled = lines.pseudo_labels(texts, "file", "text").withColumnRenamed("section_id", "file")
    labelled.orderBy("file", "line_no").select("label", "line", "file").write.mode("overwrite").partitionBy("file").option("header", True).csv(a.output_dir or f"{a.input_dir}{a.suffix}")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Train on the labelled CSV files of a folder, save the model and print the held-out report."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{a.input_dir}/*.csv")
    rows = read.select("label", "line", F.col("_metadata.file_name").alias("section_id"), F.monotonically_increasing_id().alias("line_no")).where("label IS NOT NULL AND label <> ''")
    windows = lines.context_windows(rows, 2, ("narrative", "table_row", "footer"))
    parts = evaluation.stratified_split(windows, "label", "line_no")
    model = learning.train(parts.where("is_train"))
    model.write().overwrite().save(a.model)
    held = learning.predictions(model, parts.where("NOT is_train"))
    held.write.mode("overwrite").option("header", True).option("escape", '"').csv(a.predictions or f"{a.model}_predictions")
    evaluation.classification_report(held, "true_label", "predicted_label").show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(required=True)

    def command(f, *options: tuple) -> None:
        p = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        p.set_defaults(run=f)
        for name, settings in options:
            p.add_argument(name, **settings)

    chunked = [("--filings", {"required": True}), ("--max-chunk-chars", {"type": int, "default": 2000}), ("--chunk-overlap-chars", {"type": int, "default": 400}), ("--chunker", {"choices": ["simple", "table-aware"], "default": "table-aware"}), ("--line-model", {"help": "label lines by a trained model instead of the rules"})]
    command(index, *chunked, ("--max-filings", {"type": int, "default": 6}), ("--index", {"default": "db"}))
    command(evaluate, ("--index", {"default": "db"}), ("--eval-path", {"required": True}), ("--output-path", {"required": True}), ("--output-summary-path", {}), ("--year", {"type": int}), ("--match-method", {"choices": ["hybrid", "bm25", "embedding"], "default": "hybrid"}), ("--table-bonus", {"action": argparse.BooleanOptionalAction, "default": True}))
    command(review, *chunked, ("--max-filings", {"type": int, "default": 3}), ("--out", {"required": True}))
    command(pseudo_label, ("--input-dir", {"default": "data"}), ("--output-dir", {}), ("--pattern", {"default": "*.csv"}), ("--suffix", {"default": "_annotated"}))
    command(train, ("--input-dir", {"default": "data"}), ("--model", {"default": "model/line_classifier"}), ("--predictions", {}))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
