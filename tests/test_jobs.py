"""The runnable jobs: growing input, reruns, partial runs, command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import chunk_table, grow_index, settings
from quillstone.operators import ranking, term_index

ROOT = Path(__file__).resolve().parents[1]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLE = "Premiums $1,200 $1,100\nLosses (300) (250)"


def document(i):
    text = [f"Some prose of number {i}\nwith words word{i % 4}\n{TABLE}\nmore prose", TABLE, "only prose", None, ""][i % 5]
    return (i, text, ["en", "de", None][i % 3], "src", 0)


def landed(spark, folder, numbers, mode="append"):
    spark.createDataFrame([document(i) for i in numbers], SCHEMA).coalesce(1).write.mode(mode).parquet(f"{folder}/documents.parquet")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_index_takes_only_what_is_new(spark, tmp_path):
    tables, output, mark = (f"file://{tmp_path}/{n}" for n in ("tables", "index", "mark"))
    landed(spark, tables, range(20))
    assert grow_index.run(spark, tables, output, mark)["documents"] == 20
    first = rows(grow_index.result(spark, output))
    assert grow_index.run(spark, tables, output, mark) == {"documents": 0, "batches": 0}
    assert rows(grow_index.result(spark, output)) == first
    landed(spark, tables, range(15, 40))  # five of them are known
    assert grow_index.run(spark, tables, output, mark)["documents"] == 20
    once = f"file://{tmp_path}/once"
    unique = spark.createDataFrame([document(i) for i in range(40)], SCHEMA).selectExpr("*", "struct(lang) AS scope")
    term_index.write_batch(unique, once, 0, **grow_index.KEYS)
    assert rows(grow_index.result(spark, output)) == rows(grow_index.result(spark, once)) != first
    asked = spark.createDataFrame([(1, "word3 prose", "en")], "query_id long, query string, lang string").selectExpr("query_id", "query", "struct(lang) AS scope")
    best = [rows(ranking.bm25_search(term_index.load(spark, p), asked, 3)) for p in (output, once)]
    assert best[0] == best[1] and len(best[0]) == 3


def test_index_survives_a_broken_off_batch_and_a_lost_checkpoint(spark, tmp_path, monkeypatch):
    tables, output, mark = (f"file://{tmp_path}/{n}" for n in ("tables", "index", "mark"))
    landed(spark, tables, range(10))
    write, calls = term_index.write_batch, []

    def dies(docs, path, batch, **options):
        write(docs.limit(3), path, batch, **options)
        calls.append(batch)
        raise RuntimeError("broken off")

    monkeypatch.setattr(term_index, "write_batch", dies)
    with pytest.raises(Exception, match="broken off"):
        grow_index.run(spark, tables, output, mark)
    monkeypatch.setattr(term_index, "write_batch", write)
    assert calls == [0] and grow_index.run(spark, tables, output, mark)["documents"] == 10
    want = rows(grow_index.result(spark, output))
    assert grow_index.run(spark, tables, output, f"file://{tmp_path}/other-mark")["documents"] == 10
    assert rows(grow_index.result(spark, output)) == want


def test_index_in_small_batches_is_the_same(spark, tmp_path):
    tables = f"file://{tmp_path}/tables"
    for k in range(3):
        landed(spark, tables, range(k * 8, k * 8 + 8))
    found = []
    for n in (1, 64):
        output = f"file://{tmp_path}/index-{n}"
        assert grow_index.run(spark, tables, output, f"file://{tmp_path}/mark-{n}", max_files=n, buckets=4)["batches"] == (3 if n == 1 else 1)
        found.append(rows(grow_index.result(spark, output, 4)))
    assert found[0] == found[1]


def test_chunk_table_reruns_and_grows(spark, tmp_path):
    tables, output = f"file://{tmp_path}/tables", f"file://{tmp_path}/chunks"
    landed(spark, tables, range(15))
    counts = [chunk_table.run(spark, tables, output) for _ in range(2)]
    table = chunk_table.result(spark, output)
    assert counts[0] == counts[1] == {"documents": 15, "chunks": table.count()}
    assert {r.lang for r in table.collect()} == {"en", "de", None}
    of = {r.chunk_no: r for r in table.where("doc_id = 0").collect()}
    assert [of[k].kind for k in sorted(of)] == ["narrative", "table", "narrative"]
    assert of[sorted(of)[1]].text == "Premiums | 1200.0 | 1100.0\nLosses | -300.0 | -250.0" and of[sorted(of)[1]].table_rows == 2
    assert table.where("doc_id IN (3, 4)").count() == 0
    before = rows(table.where("lang = 'de' OR lang IS NULL"))
    landed(spark, tables, range(15, 30))
    assert chunk_table.run(spark, tables, output, languages=["en"])["documents"] == 10
    after = chunk_table.result(spark, output)
    assert rows(after.where("lang = 'de' OR lang IS NULL")) == before and after.where("lang = 'en' AND doc_id >= 15").count() > 0
    assert sorted(p.name for p in (tmp_path / "chunks").glob("lang=*")) == ["lang=__HIVE_DEFAULT_PARTITION__", "lang=de", "lang=en"]


def test_rows_that_share_an_id_are_cut_one_by_one(spark):
    docs = spark.createDataFrame([document(0), document(0), (None, "a\nb", "en", "s", 0), (None, TABLE, "en", "s", 0)], SCHEMA)
    assert chunk_table.chunks(docs).where("doc_id = 0").count() == 6 and chunk_table.chunks(docs).where("doc_id IS NULL").count() == 2


def test_jobs_leave_the_session_as_it_was(spark, tmp_path):
    tables = f"file://{tmp_path}/tables"
    landed(spark, tables, range(5))
    before = dict(spark.conf.getAll)
    chunk_table.run(spark, tables, f"file://{tmp_path}/c")
    grow_index.run(spark, tables, f"file://{tmp_path}/i", f"file://{tmp_path}/m")
    assert dict(spark.conf.getAll) == before


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"languages": ["en"], "compression": None}))
    assert settings.config(spark, f"file://{tmp_path}/a.json", chunk_table.SETTINGS) == {"languages": ["en"], "compression": "zstd"}
    assert settings.config(spark, f"file://{ROOT}/jobs/grow_index.json", grow_index.SETTINGS) == grow_index.SETTINGS
    assert settings.config(spark, f"file://{ROOT}/jobs/chunk_table.json", chunk_table.SETTINGS) == chunk_table.SETTINGS
    (tmp_path / "b.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError, match="colour"):
        settings.config(spark, f"file://{tmp_path}/b.json", chunk_table.SETTINGS)


@pytest.mark.parametrize("job, extra", [("chunk_table", []), ("grow_index", ["--checkpoint", "mark"])])
def test_command_line(spark, tmp_path, job, extra):
    landed(spark, f"file://{tmp_path}/tables", range(6))
    args = ["--tables", f"{tmp_path}/tables", "--output", f"{tmp_path}/out", *[f"{tmp_path}/{x}" if x == "mark" else x for x in extra], "--config", f"{ROOT}/jobs/{job}.json"]
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 6" in done.stderr and (tmp_path / "out").is_dir()
