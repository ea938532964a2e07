import json

from quillstone.cli import main


def filings(spark, path):
    text = "\n".join(["Our business had a good year, as this section tells at some length."] * 20 + ["Total revenues 43,736 41,000 40,000", "total aig shareholders' equity 66,362 60,000"] * 6)
    rows = [(f"f{y}", f"{y}-02-01", "Item 8", text.replace("43,736", f"4{y - 2020},736")) for y in (2021, 2022, 2023)] + [("f2022", "2022-02-01", "Item 7", "  ")]
    spark.createDataFrame(rows, "filing_id string, filing_date string, section string, text string").selectExpr("filing_id", "CAST(filing_date AS DATE) filing_date", "section", "text").write.parquet(path)


def test_index_and_evaluate(spark, tmp_path, capsys):
    filings(spark, f"{tmp_path}/filings")
    for _ in range(2):
        main(["index", "--filings", f"{tmp_path}/filings", "--index", f"{tmp_path}/db", "--max-chunk-chars", "800"])
    first, second = (json.loads(x) for x in capsys.readouterr().out.strip().splitlines())
    assert first == second and first["total_chunks"] > 2 and first["table_chunks"] > 0
    (tmp_path / "truth.csv").write_text('year,total_revenues,shareholders_equity\n2021,"41,736","66,362"\n2022,"99,999","66,362"\n')
    main(["evaluate", "--index", f"{tmp_path}/db", "--eval-path", f"{tmp_path}/truth.csv", "--output-path", f"{tmp_path}/out", "--output-summary-path", f"{tmp_path}/csv"])
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["cases"] == 8 and summary["retrieval_hit"] >= 3
    got = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert got.count() == 8 and got.where("correct = 'true' AND variable = 'total_revenues' AND year = 2021").count() == 1
    stats = spark.read.json(f"{tmp_path}/db/_chunk_stats").first()
    assert stats.total_chunks == first["total_chunks"] == sum(b["count"] for b in stats.histogram) and stats.char_stats.max <= 1300
    for method in ("bm25", "embedding"):
        main(["evaluate", "--index", f"{tmp_path}/db", "--eval-path", f"{tmp_path}/truth.csv", "--output-path", f"{tmp_path}/{method}", "--match-method", method])
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["cases"] == 8


def test_review_and_labels(spark, tmp_path):
    filings(spark, f"{tmp_path}/filings")
    main(["review", "--filings", f"{tmp_path}/filings", "--out", f"{tmp_path}/review", "--chunker", "simple"])
    assert spark.read.json(f"{tmp_path}/review").count() > 1
    header = spark.read.json(f"{tmp_path}/review/_stats").first()
    assert header.chunk_count == spark.read.json(f"{tmp_path}/review").count() == sum(b["count"] for b in header.histogram)
    data = tmp_path / "data"
    data.mkdir()
    (data / "a.csv").write_text('line\n"Total revenues 1,100 1,200"\n\nplain prose here\nSegment overview\n' * 12)
    (data / "b_annotated.csv").write_text("line\nskipped\n")
    main(["pseudo-label", "--input-dir", str(data), "--output-dir", f"{tmp_path}/labelled"])
    got = spark.read.option("header", True).csv(f"{tmp_path}/labelled")
    assert {r.label for r in got.collect()} >= {"table_row", "narrative", "footer"} and {r.file for r in got.collect()} == {"a.csv"}
