"""Page context from a stream: out of order, repeated, late, restarted."""

import datetime as dt

from quillstone.operators import lines
from quillstone.streaming.page_stream import LANDED, complete_sections, page_stream

START = dt.datetime(2024, 1, 1)
SECTION = ["ITEM 1 | First | Part", "some prose", "12", "", "ITEM 2 | Second", "Revenues 1,200 1,100", "more", "AIG | 2024 Form 10-K 7"]


def land(spark, folder, rows):
    schema = ", ".join(f.strip() for f in LANDED.split(","))
    spark.createDataFrame([(s, n, x, START + dt.timedelta(minutes=m)) for s, n, x, m in rows], schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base):
    page_stream(spark, f"{base}/landing", f"{base}/out", f"{base}/mark").awaitTermination()


def shown(df):
    return sorted(map(repr, df.drop("batch").select("section_id", "line_no", "line", "label", "page_number", "form_label", "page_section", "page_subsection", "is_title").collect()))


def batch(spark, ids):
    return lines.classify(spark.createDataFrame([(i, "\n".join(SECTION)) for i in ids], "section_id long, text string"), "section_id", "text")


def test_out_of_order_lines_equal_the_batch(spark, tmp_path):
    base = f"file://{tmp_path}"
    rows = [(s, n, x, (7 * n + s) % 20) for s in (1, 2) for n, x in enumerate(SECTION)]
    land(spark, f"{base}/landing", rows[::2][::-1])
    land(spark, f"{base}/landing", rows[1::2] + rows[:3])
    run(spark, base)  # nothing is complete yet
    land(spark, f"{base}/landing", [(3, n, x, 300) for n, x in enumerate(SECTION)])
    run(spark, base)
    out = spark.read.parquet(f"{base}/out")
    assert shown(out) == shown(batch(spark, [1, 2]))
    land(spark, f"{base}/landing", [(1, 2, "99", 5), (9, 0, "end", 3000)])  # the first is a day late
    run(spark, base)
    assert shown(spark.read.parquet(f"{base}/out")) == shown(batch(spark, [1, 2, 3]))
    before = shown(spark.read.parquet(f"{base}/out"))
    run(spark, base)
    assert shown(spark.read.parquet(f"{base}/out")) == before


def test_the_same_in_a_batch(spark):
    schema = ", ".join(f.strip() for f in LANDED.split(","))
    rows = [(s, n, x, START + dt.timedelta(minutes=n)) for s in (1, 2) for n, x in enumerate(SECTION)]
    df = complete_sections(spark.createDataFrame(rows[::-1] + rows[:5], schema), "1 hour", "30 minutes")
    assert sorted((r.section_id, r.text) for r in df.collect()) == [(1, "\n".join(SECTION)), (2, "\n".join(SECTION))]
