import collections
import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dup
from quillstone.llm.exact_dup import deduplicate, exact_duplicates, md5_128
from quillstone.llm.oracles import SQL

FOLDER = "/root/testdata/sf0.001"
ROWS = [
    (5, "same", "a"), (3, "same", "b"), (9, "same", "c"), (1, "Same", "d"), (2, None, "e"), (7, "", "f"), (4, "same ", "g"),
    (9, "same", "c"), (None, "same", "h"), (None, "no id", "i"), (None, "no id", "j"), (8, "x" * 200_000, "k"), (6, "x" * 200_000, "l"), (10, "x" * 199_999 + "y", "m"),
]
SCHEMA = "doc_id long, text string, source string"


def brute(rows, keep):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "largest" else min(known)) if known else None
        left = 1
        for i in ids:
            kept = bool(left and i == best)
            left -= kept
            out.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


DIGESTS = {"md5": md5_128, "first byte": lambda c: F.substring(md5_128(c), 1, 1), "length": lambda c: F.length(c), "nothing": lambda c: F.lit(0)}


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("limit", [exact_dup.BROADCAST_GROUPS, 0])
def test_collisions_are_told_apart_by_bytes(spark, monkeypatch, digest, keep, limit):
    monkeypatch.setattr(exact_dup, "BROADCAST_GROUPS", limit)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert got(exact_duplicates(docs, keep=keep, digest=DIGESTS[digest])) == brute(ROWS, keep)


def test_many_small_groups_beside_a_hot_one(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 5}", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(exact_duplicates(docs, keep="largest")) == brute(rows, "largest")


def test_deduplicate_keeps_columns_of_any_name_and_agrees_with_itself(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).select("*", F.lit(1).alias("rid"), F.lit(2).alias("h"), F.lit(3).alias("kept"), F.lit(4).alias("row_number"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    for keep in ("smallest", "largest"):
        once = [sorted(map(repr, deduplicate(docs.repartition(n), keep=keep).collect())) for n in (1, 5)]
        assert once[0] == once[1] and len(once[0]) == len({t or "" for _, t, _ in ROWS})
        assert deduplicate(docs, keep=keep).columns == docs.columns
    left = {(r.doc_id, r.text) for r in deduplicate(docs).collect()}
    assert (3, "same") in left and (None, "no id") in left and (6, "x" * 200_000) in left and (2, None) in left


def test_normalised_texts_are_compared(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = exact_duplicates(docs, normalise=lambda c: F.lower(F.trim(c)))
    assert found.where("group_size = 7 AND keep_id = 1").count() == 7


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(docs).count() == 0 and deduplicate(docs).count() == 0


def test_only_native_operators(spark):
    plan = exact_duplicates(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the supplied tables are not here")
def test_query_matches_sql(spark):
    from quillstone.llm.queries import op11_exact_dedup

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    assert got(op11_exact_dedup(spark, FOLDER)) == sorted(con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({SQL['op11_exact_dedup']})").fetchall(), key=repr)
