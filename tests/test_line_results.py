"""Full results of lines, number matching, retrieval plans, vectors, labellers, and chunks over Arrow batches."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking, embedding, evaluation, extraction, learning, lines, ranking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize(
    ("line", "kind", "label", "values", "years", "mentions"),
    [
        ("Reserves: $1,204 (87) 3.5", "table_row", "Reserves", [1204.0, -87.0], None, None),
        ("TABLE | Net amount $(1,404)", "single_value", "Net amount", [-1404.0], None, None),
        ("2023 2022 2021", "year_header", None, None, [2023, 2022, 2021], None),
        ("net loss was 12 million, as expected", "narrative", None, None, None, [("net loss", 12.0)]),
        ("SEGMENT DISCUSSION", "header", None, None, None, None),
        ("", "other", None, None, None, None),
    ],
)
def test_parse_any_line(spark, line, kind, label, values, years, mentions):
    r = one(spark, line, T.parse_any_line)
    assert (r.type, r.label, r["values"], r.years) == (kind, label, values, years)
    assert (None if r.mentions is None else [(m.label, m.value) for m in r.mentions]) == mentions
    assert r.original == line.replace("TABLE | ", "").strip()


def test_repeated_mentions_have_their_own_unit(spark):
    found = one(spark, "net loss 5, the net loss 5 billion. Net income of $2B, net loss 5", T.mentions)
    assert [(m.label, m.value) for m in found] == [("net loss", 5.0), ("net loss", 5000.0), ("net income", 2000.0), ("net loss", 5.0)]


@pytest.mark.parametrize(
    ("truth", "text", "excerpt", "hit"),
    [
        ("-1,234", "a loss of ( 1,234 ) for the year", None, True),
        ("5000", "a loss of ( 5,000 ) for the year", None, False),
        ("5000", "+$5,050 then", None, True),
        ("5000", "nothing", "in the excerpt 4,950.5", True),
        ("5000", "nothing", None, False),
        ("BBB+", "rated bbb+ today", None, True),
        ("BBB+", "not here", "rated bbb+", False),
        ("", "anything", "", False),
    ],
)
def test_number_and_text_matches(spark, truth, text, excerpt, hit):
    row = spark.createDataFrame([(truth, text, excerpt)], "truth string, text string, excerpt string")
    assert row.select(evaluation.doc_matches(F.col("truth"), F.col("text"), F.col("excerpt")).alias("r")).first().r is hit


def test_lowest_match_keeps_a_share(spark):
    """The scale runs from 0, which most documents of the pool have, so the weakest match keeps a share and is not 0."""
    docs = [(1, "z z z z", "s"), (2, "a b c z", "s"), *[(k, f"w{k} v{k} u{k} t{k}", "s") for k in range(3, 9)]]
    index = ranking.bm25_index(spark.createDataFrame(docs, "id long, text string, scope string"), "id", "text", "scope")
    asked = spark.createDataFrame([("q", "s", "z")], "query_id string, scope string, query string")
    got = {r.id: r.norm for r in ranking.bm25_normalized(index, asked).collect()}
    # All lengths are the mean, so a score is idf * tf * 2.5 / (tf + 1.5): 4 * 2.5 / 5.5 against 2.5 / 2.5.
    assert got == {1: 1.0, 2: pytest.approx(5.5 / 10), **{k: 0.0 for k in range(3, 9)}}


def test_query_plans(spark):
    cases = spark.createDataFrame([("a", "Total", "q", 2024), ("b", "Other", "q", 2024)], "case_id string, display_name string, query string, year int")
    answer = '```json\n{"locate_terms": [" Income  statement.", "income statement", "Income statement", "", null], "table_terms": ["t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8", "t9"]}\n```'
    got = {r.case_id: r for r in extraction.query_plans(cases, lambda p: answer if "'Total'" in p else "no idea").collect()}
    assert got["a"].locate_terms == ["Income statement", "income statement"] and got["a"].table_terms == [f"t{k}" for k in range(1, 9)] and got["a"].constraint_terms == []
    assert got["b"].locate_terms == got["b"].table_terms == []
    assert extraction.query_plans(cases).where("size(locate_terms) > 0").count() == 0


def test_embeddings_rank_by_meaningful_overlap(spark):
    texts = [(1, "shareholders equity total"), (2, "weather in the north"), (3, None)]
    vectors = embedding.embed(spark.createDataFrame(texts, "id long, text string"), "text").drop("text")
    asked = embedding.embed(spark.createDataFrame([("q", "total equity of shareholders")], "query_id string, text string"), "text").drop("text")
    assert [r.id for r in ranking.vector_topk(vectors, asked, 3).orderBy("rank").collect()][0] == 1
    assert len(vectors.first().embedding) == embedding.WIDTH


def section(rng):
    out = []
    for _ in range(rng.randint(1, 60)):
        out.append(rng.choice(["Premiums 1,204 980 77", "GOODWILL AND OTHER", "plain words of a sentence here", "", "12", "Losses (5) (70)", "x" * rng.randint(1, 120), "ITEM 8 | Notes | 3. Segments"]))
    return "\n".join(out)


def plain_chunks(rows, size, overlap):
    """Sections one by one, in plain Python."""
    chunks = []
    for r in rows:
        if not chunks or (r.label == "table_row") != (chunks[-1][-1].label == "table_row"):
            chunks.append([])
        chunks[-1].append(r)
    made = []
    for part in chunks:
        said = [r.line for r in part if r.label == "narrative"]
        names = [part[0].page_section, part[0].page_subsection, part[0].page_subsubsection]
        c = chunking.Chunk([(r.line, r.label) for r in part], {"page_context": " - ".join(n for n in names if n)}, context_lines=said[-5:] if part[0].label == "table_row" else said[:5], titles=[r.line for r in part if r.is_title]).refresh()
        made += [c] if c.text else []
    made = chunking.merge_small(chunking.split_oversized(made, size))
    chunking.add_overlap(made, overlap)
    return [(n, c.text, chunking.summary_of(c)) for n, c in enumerate(made)]


def test_chunks_of_many_sections_equal_single_ones(spark):
    rng = random.Random(6)
    rows = [(i, section(rng), 2020 + i % 3) for i in range(150)] + [(900, "", 2020), (901, "only", 2020), (902, None, 2020)]
    df = spark.createDataFrame(rows, "id long, text string, year int")
    labelled = chunking.line_islands(lines.classify(df, "id", "text", "year")).orderBy("section_id", "line_no").collect()
    by = {}
    for r in labelled:
        by.setdefault(r.section_id, []).append(r)
    want = sorted((s, *c) for s, part in by.items() for c in plain_chunks(part, 400, 80))
    got = sorted((r.section_id, r.chunk_no, r.text, r.summary) for r in chunking.table_aware_chunks(df, "id", "text", "year", size=400, overlap=80).collect())
    assert got == want and len(got) > 250


def test_summaries():
    c = chunking.Chunk([("long " * 200, "narrative"), ("second", "narrative")], {"page_context": ""}, context_lines=["context"], titles=["A TITLE"])
    assert chunking.summary_of(c) == "A TITLE"
    assert chunking.summary_prompt(c) == "Titles: A TITLE\nContext: context"
    assert chunking.summary_of(c, lambda p: ' "made of ' + p.splitlines()[0] + '" ') == "made of Titles: A TITLE"
    assert chunking.summary_of(chunking.Chunk([], {"page_context": ""}), lambda p: "never asked") == "No summary"


def test_labeller_from_a_saved_model(spark, tmp_path):
    rng = random.Random(2)
    text = "\n".join(rng.choice(["Premiums 1,204 980", "plain words of prose", "ITEM 8 | Notes"]) for _ in range(150)) + "\n\n42\n\nplain words of prose"
    sections = spark.createDataFrame([(1, text)], "id long, text string")
    rows = lines.pseudo_labels(sections, "id", "text").withColumn("label", F.when(F.col("line").startswith("Prem"), "table_row").when(F.col("line").startswith("ITEM"), "footer").otherwise(F.when(F.col("line") == "", "blank").otherwise("narrative")))
    model = learning.train(lines.context_windows(rows, 2, ("narrative", "table_row", "footer")), max_iter=30)
    model.write().save(f"{tmp_path}/model")
    again = learning.load(spark, f"{tmp_path}/model")
    got = lines.classify(sections, "id", "text", labeller=learning.labeller(again)).collect()
    want = {"Prem": "table_row", "plai": "narrative", "ITEM": "footer", "42": "footer"}
    assert len(got) == 152 and sum(r.label == want[r.line[:4]] for r in got) >= 150
    assert [r.label for r in got if r.line == "42"] == ["footer"]
    assert set(learning.predictions(again, lines.context_windows(rows, 2, ("footer",))).columns) == {"input", "true_label", "predicted_label"}
    with pytest.raises(FileNotFoundError):
        learning.load(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("size, overlap", [(400, 80), (150, 20), (2000, 400), (0, 0), (60, 300)])
def test_folded_chunks_equal_the_pass_in_python(spark, size, overlap):
    rng = random.Random(size + overlap)
    rows = [(i, section(rng), 2020 + i % 3) for i in range(60)] + [(900, "", 2020), (901, "only", 2020), (902, None, 2020), (903, "Premiums 1,204 980 77\n" * 40 + "word " * 300, 2021)]
    df = spark.createDataFrame(rows, "id long, text string, year int")
    made = [chunking.table_aware_chunks(df, "id", "text", "year", size=size, overlap=overlap, summarise=s) for s in (None, lambda _: "")]
    assert made[0].columns == made[1].columns
    assert [sorted(map(repr, m.collect())) for m in made][0] == sorted(map(repr, made[1].collect()))
    plan = made[0]._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan
