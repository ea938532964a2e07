"""Operators on small fixtures: chunking, ranking, evaluation, sources, streaming."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import chunking, evaluation, extraction, learning, lines, ranking
from quillstone.sources import tables
from quillstone.streaming.index_stream import index_stream


@given(st.lists(st.integers(2, 700), min_size=1, max_size=40), st.integers(50, 900))
@settings(max_examples=200, deadline=None)
def test_split_cores_partition_the_lines(sizes, most):
    pieces = chunking.split_bounds(sizes, most)
    cores = [(a, b) for _, _, a, b in pieces]
    assert cores[0][0] == 0 and cores[-1][1] == len(sizes) and all(x[1] == y[0] for x, y in itertools.pairwise(cores))
    for first, last, start, _ in pieces:
        assert first <= start < last
        assert sum(sizes[first:last]) <= most or last == first + 1


def section(spark, text, year=2024):
    return spark.createDataFrame([(1, year, text)], "section_id long, year int, text string")


def test_simple_chunks_cover_the_text(spark):
    text = "".join(random.Random(1).choice("abc \n") for _ in range(2345))
    for size, overlap in ((1000, 100), (300, 299), (5000, 10), (2345, 0)):
        got = [r.text for r in chunking.simple_chunks(section(spark, text), "section_id", "text", size=size, overlap=overlap).orderBy("chunk_no").collect()]
        assert got[0] + "".join(c[overlap:] for c in got[1:]) == text
    assert chunking.simple_chunks(section(spark, ""), "section_id", "text").count() == 0
    with pytest.raises(ValueError):
        chunking.simple_chunks(section(spark, text), "section_id", "text", size=100, overlap=100)


def test_table_aware_chunks(spark):
    prose = ["We discuss our results in this section at some length today."] * 12
    rows = [f"Premiums item{i} text {i},100 {i},200" for i in range(1, 15)]
    text = "\n".join([*prose, "ITEM 8 | Notes | Segment", *rows, "", "12", "", "Closing words."])
    got = chunking.table_aware_chunks(section(spark, text), "section_id", "text", "year", size=400, overlap=50).orderBy("chunk_no").collect()
    assert [r.chunk_no for r in got] == list(range(len(got)))
    whole = "\n".join(r.text for r in got)
    assert "ITEM 8" not in whole and "\n12\n" not in whole  # footers are dropped
    assert all(f"item {i} text | {i}100.0 | {i}200.0" in whole for i in range(1, 15))
    tables_ = [r for r in got if r.chunk_type == "table"]
    assert tables_ and all(r.page_section == "ITEM 8" and r.page_context == "ITEM 8 - Notes - Segment" for r in tables_)
    assert all(r.summary for r in got) and got[-1].text.endswith("Closing words.")


def test_page_context_keeps_first_page_and_last_section(spark):
    text = "intro here\n\n7\n\nITEM 1 | Overview | B\nmore text\nITEM 2 | Summary\n\n9\n\nend of text"
    got = {r.line: r for r in lines.classify(section(spark, text), "section_id", "text").collect()}
    assert got["intro here"].page_number is None
    end = got["end of text"]
    assert (end.page_number, end.page_section, end.page_subsection, end.page_subsubsection) == (7, "ITEM 2", "Summary", None)


DOCS = [(1, "s", "a b c a"), (2, "s", "b c d"), (3, "s", "x y"), (4, "t", "a a")]


def test_bm25_by_hand(spark):
    import math

    df = spark.createDataFrame(DOCS, "id long, scope string, text string")
    index = ranking.bm25_index(df, "id", "text", "scope")
    queries = spark.createDataFrame([(9, "s", "a a d"), (8, "s", None), (7, "t", "a")], "query_id long, scope string, query string")
    got = {(r.query_id, r.id): r.score for r in ranking.bm25_scores(index, queries).collect()}
    idf = lambda df_: math.log(3 - df_ + 0.5) - math.log(df_ + 0.5)
    vocabulary = {"a": 1, "b": 2, "c": 2, "d": 1, "x": 1, "y": 1}
    mean = sum(map(idf, vocabulary.values())) / 6
    floor = lambda t: idf(vocabulary[t]) if idf(vocabulary[t]) >= 0 else 0.25 * mean
    gain = lambda t, tf, dl: floor(t) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 3))
    assert abs(got[9, 1] - 2 * gain("a", 2, 4)) < 1e-9 and abs(got[9, 2] - gain("d", 1, 3)) < 1e-9
    top = ranking.bm25_topk(index, queries, 3).collect()
    assert [r.id for r in sorted((r for r in top if r.query_id == 8), key=lambda r: r["rank"])] == [1, 2, 3]
    assert all(0 <= r.bm25_score <= 1 for r in top)


def test_fusion_without_vectors_is_the_bm25_part(spark):
    bm25 = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5)], "query_id long, id long, norm double")
    chunks = spark.createDataFrame([(1, "narrative_main"), (2, "table_main"), (3, None)], "id long, chunk_nature string")
    none = spark.createDataFrame([], "query_id long, id long, distance double")
    got = {r.id: r.hybrid_score for r in ranking.fuse(bm25, none, chunks).collect()}
    assert got == {1: 1.0, 2: 1.0}
    near = spark.createDataFrame([(1, 2, 0.0), (1, 3, 4.0)], "query_id long, id long, distance double")
    assert {r.id: r.hybrid_score for r in ranking.fuse(bm25, near, chunks).collect()} == {1: 1.0, 2: 2.0, 3: 0.0}
    assert {r.id: r.hybrid_score for r in ranking.fuse(bm25, near, chunks, polarity="distance", table_bonus=False).collect()} == {1: 1.0, 2: 0.5, 3: 1.0}
    with pytest.raises(ValueError):
        ranking.fuse(bm25, near, chunks, polarity="other")


def test_minmax_of_equal_values(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 0.0), ("c", 1.0), ("c", 3.0)], "g string, v double")
    assert sorted((r.g, r.norm) for r in ranking.minmax(rows, "v", "g").collect()) == [("a", 1.0), ("a", 1.0), ("b", 0.0), ("c", 0.0), ("c", 1.0)]


def test_factories():
    assert chunking.chunk_builder("simple") is chunking.simple_chunks
    for f in (chunking.chunk_builder, ranking.retriever):
        with pytest.raises(ValueError):
            f("unknown")


def test_evaluation_case_of_one_row(spark):
    rows = spark.createDataFrame([("2021", "100", "50", "A")], "year string, total_revenues string, shareholders_equity string, sp_rating string")
    variables = spark.createDataFrame([("total_revenues",), ("shareholders_equity",), ("sp_rating",), ("underwriting_income",)], "variable string")
    from quillstone.functions import text as T

    cases = evaluation.eval_cases(rows, variables).withColumn("prediction", F.lit("100")).withColumn("correct", T.values_match(F.lit("100"), F.col("ground_truth")))
    docs = cases.withColumn("text", F.lit("it was 100 in all")).withColumn("doc_rank", F.lit(1)).withColumn("supporting_docs", F.array(F.lit(1)))
    got = evaluation.summary(cases.join(evaluation.rank_in_docs(docs, "year", "variable"), ["year", "variable"])).first()
    assert (got.cases, got.accuracy) == (4, 0.5)  # 50 is within the tolerance of 100
    empty = evaluation.summary(spark.createDataFrame([], "correct boolean, retrieval_hit boolean, retrieval_rank int")).first()
    assert tuple(empty) == (0, 0, 0.0, 0, 0.0, 0.0)


def test_extraction_is_offline_and_deterministic(spark):
    docs = "Document 1\nTotal revenues | 9,123\n\n---\n\nDocument 2\ntotal revenues 9,123\n\n---\n\nDocument 3\ntotal revenues 8"
    cases = spark.createDataFrame([("a", docs, "total revenue", 2022, ["total revenues"]), ("b", "nothing", "total revenue", 2022, ["total revenues"])], "case_id string, documents string, target string, year int, aliases array<string>")
    got = {r.case_id: (r.value, r.supporting_docs) for r in extraction.extract_values(cases).collect()}
    assert got == {"a": ("9,123", [1, 2]), "b": ("N/A", [])}


def test_stratified_split_shares(spark):
    rows = spark.range(1000).withColumn("label", F.when(F.col("id") % 4 == 0, "x").otherwise("y"))
    got = evaluation.stratified_split(rows, "label", "id").groupBy("label").agg(F.count_if("is_train").alias("n")).collect()
    assert {r.label: r.n for r in got} == {"x": 200, "y": 600}


def test_sources(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    (tmp_path / "rows.csv").write_text('Label ,LINE\nTable_Row,"a, b"\n,dropped\nfooter,\n')
    assert [tuple(r) for r in tables.read_labelled(spark, path).collect()] == [("table_row", "a, b"), ("footer", "")]
    (tmp_path / "none.csv").write_text("other,LINE\n1,2\n")
    assert tables.read_labelled(spark, str(tmp_path / "none.csv")).count() == 0


def test_index_is_appended_once(spark, tmp_path):
    index = str(tmp_path / "index")
    rows = spark.createDataFrame([("a", 2021), ("a", 2021), ("b", 2022)], "id string, year int")
    tables.upsert(rows, index)
    tables.upsert(rows.unionByName(spark.createDataFrame([("c", 2022)], "id string, year int")), index)
    assert sorted(r.id for r in spark.read.parquet(index).collect()) == ["a", "b", "c"]


def test_stream_replays_leave_one_copy(spark, tmp_path):
    section(spark, "some text " * 300).withColumn("section", F.lit("item")).write.parquet(str(tmp_path / "landing"))
    for run in range(2):
        index_stream(spark, str(tmp_path / "landing"), "section_id long, year int, text string, section string", str(tmp_path / "index"), str(tmp_path / f"check-{run}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "index"))
    assert got.count() == got.select("id").distinct().count() == 4


def test_line_classifier_learns_the_labels(spark):
    made = []
    for i in range(120):
        made += [(1, 3 * i, f"Premiums {i},100 {i},200", "table_row"), (1, 3 * i + 1, "our results were good this year", "narrative"), (1, 3 * i + 2, f"ITEM {i % 9} | Notes", "footer")]
    windows = lines.context_windows(spark.createDataFrame(made, "section_id long, line_no int, line string, label string"), 2, ("table_row", "narrative", "footer"))
    model = learning.train(windows, features=512, max_iter=10)
    report = evaluation.classification_report(learning.predict(model, windows)).collect()
    assert len(report) == 3 and all(r.f1 > 0.95 for r in report)


def test_batches_of_the_index_replace_what_broke_off(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = lambda ids: spark.createDataFrame([(i, 2021 + len(i)) for i in ids], "id string, year int")
    tables.upsert(rows(["a"]).limit(0), path, 0)
    tables.upsert(rows(["a", "b", "b"]), path, 0)
    tables.upsert(rows(["c"]), path, 1)  # broken off after one row
    tables.upsert(rows(["b", "c", "dd"]), path, 1)
    tables.upsert(rows(["b", "c", "dd"]), path, 1)
    tables.upsert(rows(["a", "dd"]), path, 2)
    assert sorted((r.id, r.batch) for r in spark.read.parquet(path).collect()) == [("a", 0), ("b", 0), ("c", 1), ("dd", 1)]
