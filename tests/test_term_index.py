"""The stored index against a full build, and pruned search against brute force."""

import math
import random
from collections import Counter

import pytest

from quillstone.operators import ranking, term_index

SCHEMA = "id long, text string, scope string"
KEYS = {"id_col": "id", "text_col": "text", "scope_col": "scope"}


def collection(seed, n):
    """Frequent and rare words, short and long documents, repeated texts, three scopes, one of them null."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 20, 80]))), rng.choice(["a", "b", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "b"), (n + 2, rows[0][1], rows[0][2])]


def okapi(pool, query):
    counts = {i: Counter((t or "").split()) for i, t in pool.items()}
    mean = sum(sum(c.values()) for c in counts.values()) / len(pool)
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log(len(pool) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else floor for w, x in idf.items()}
    return {i: sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in query.split()) for i, c in counts.items()}


def pools(rows):
    return {s: {i: t for i, t, g in rows if g == s} for s in ("a", "b", None)}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = collection(1, 600)
    path = f"file://{tmp_path_factory.mktemp('terms')}"
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("id", "text", "struct(scope) AS scope")
    term_index.write_batch(docs, path, 0, **KEYS, buckets=4)
    return rows, term_index.load(spark, path, 4), docs


def asked(spark, texts):
    return spark.createDataFrame([(q, t, s) for q, t in enumerate(texts) for s in ("a", "b", None)], "query_id long, query string, scope string").selectExpr("query_id", "query", "struct(scope) AS scope")


QUERIES = ["w0 w1 w2 w250 w250", "w3", "w0 w0 w0", "w299 w298 w150 w0 w1", "nowhere", "nowhere w40 w41 w42 w43 w44 w0 w1 w2 w3 w4 w5"]


@pytest.mark.parametrize("probed", [1, 50])
def test_pruned_search_equals_brute_force(spark, stored, monkeypatch, probed):
    monkeypatch.setattr(ranking, "PROBED", probed)
    rows, index, _ = stored
    got = {(r.query_id, r.scope.scope, r["rank"]): (r.id, r.score) for r in ranking.bm25_search(index, asked(spark, QUERIES), 5).collect()}
    want = {}
    for q, text in enumerate(QUERIES):
        for scope, pool in pools(rows).items():
            held = {i: round(s, 6) for i, s in okapi(pool, text).items() if set(text.split()) & set((pool[i] or "").split())}
            want |= {(q, scope, n + 1): (i, held[i]) for n, i in enumerate(sorted(held, key=lambda i: (-held[i], i))[:5])}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


@pytest.mark.parametrize("shortest", [0, 32])
def test_scaled_search_equals_the_whole_pool(spark, stored, monkeypatch, shortest):
    """Without probes for the start of the scale every query goes over its whole pool."""
    monkeypatch.setattr(ranking, "SHORTEST", shortest)
    rows, index, _ = stored
    got = {(r.query_id, r.scope.scope, r["rank"]): (r.id, r.bm25_score) for r in ranking.bm25_topk(index, asked(spark, QUERIES[:4] + ["w0"]), 5).collect()}
    for q, text in enumerate(QUERIES[:4] + ["w0"]):
        for scope, pool in pools(rows).items():
            s = okapi(pool, text)
            low, high = min(s.values()), max(s.values())
            norm = {i: round(float(x > 0) if high - low <= 1e-12 else (x - low) / (high - low), 6) for i, x in s.items()}
            assert [got[q, scope, n + 1] for n in range(5)] == [(i, pytest.approx(norm[i], abs=2e-6)) for i in sorted(norm, key=lambda i: (-norm[i], i))[:5]]


def test_candidates_are_few_and_only_asked_terms_are_read(spark, stored):
    rows, index, _ = stored
    found = ranking.ask(index, asked(spark, ["w0 w1 w2 w250 w251 w252"]))
    assert ranking.bm25_candidates(found, 2).count() < 0.5 * ranking.bm25_scores(index, asked(spark, ["w0 w1 w2 w250 w251 w252"])).count()
    plan = found.postings._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in plan and "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def plain(index):
    return sorted(((r.scope.scope, r.term, r.df, r.max_tf, r.min_dl, round(r.idf, 9)) for r in index.terms.collect()), key=repr), sorted(((r.scope.scope, r.n, round(r.avgdl, 9)) for r in index.scopes.collect()), key=repr)


def test_batches_and_replays_equal_a_full_build(spark, stored, tmp_path):
    rows, index, docs = stored
    path = f"file://{tmp_path}/terms"
    for batch, where in ((0, "id % 3 = 0"), (1, "id % 3 = 1"), (1, "id % 3 = 1"), (2, "id % 3 <> 1"), (3, "false")):
        part = docs.where(where)
        term_index.append(part.unionByName(part.limit(3)), path, batch, **KEYS, buckets=4)
    grown = term_index.load(spark, path, 4)
    assert plain(grown) == plain(index) == plain(ranking.bm25_index(docs, "id", "text", "scope"))
    assert grown.postings.count() == index.postings.count() and grown.documents.count() == len(rows)
    # Cut anew after a lost checkpoint: everything arrives as batch 0 again.
    term_index.append(docs, path, 0, **KEYS, buckets=4)
    assert plain(term_index.load(spark, path, 4)) == plain(index)


def test_half_a_batch_is_not_read(spark, stored, tmp_path, monkeypatch):
    _, index, docs = stored
    path = f"file://{tmp_path}/terms"
    term_index.append(docs.where("id < 300"), path, 0, **KEYS, buckets=4)
    before = plain(term_index.load(spark, path, 4))
    term_index.append(docs.where("id >= 300"), path, 1, **KEYS, buckets=4)
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scopes/batch=1"), True)
    half = term_index.load(spark, path, 4)
    assert plain(half) == before and half.postings.where("id >= 300").isEmpty()


def test_counts_by_runs(spark):
    rows = [(1, "b a  b\tc\nb", "s"), (2, "", "s"), (3, None, "s"), (4, "x " * 30_000, None)]
    got = {r.id: (r.dl, [(c.term, c.tf) for c in r.counts]) for r in term_index.counted_terms(spark.createDataFrame(rows, SCHEMA), **KEYS).collect()}
    assert got == {1: (5, [("a", 1), ("b", 3), ("c", 1)]), 2: (0, []), 3: (0, []), 4: (30_000, [("x", 30_000)])}


def test_writing_shuffles_terms_and_not_texts_or_postings(spark, tmp_path):
    """A row for each term and task, and texts stay where they are unless ids are repeated or known."""
    from pyspark.sql import functions as F

    texts = spark.range(400).select(F.col("id"), F.lit("a b c d e " * 3).alias("text"), F.struct(F.lit("x").alias("scope")).alias("scope")).coalesce(2)
    path, seen = f"file://{tmp_path}/few", []
    write = term_index.write_batch
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(term_index, "write_batch", lambda docs, *a, **k: (seen.append(docs._jdf.queryExecution().optimizedPlan().toString()), write(docs, *a, **k)))
        term_index.append(texts, path, 0, **KEYS, buckets=4)
        term_index.append(texts.withColumn("id", F.col("id") + 400), path, 1, **KEYS, buckets=4)
        term_index.append(texts.withColumn("id", F.col("id") + 600), path, 2, **KEYS, buckets=4)
    assert ["Window" in p or "Join" in p for p in seen] == [False, False, True]
    assert spark.read.parquet(f"{path}/postings").where("batch = 0").count() == 10
    index = term_index.load(spark, path, 4)
    assert index.postings.count() == 5 * 1000 and index.documents.count() == 1000
    assert {(r.term, r.df, r.max_tf, r.min_dl) for r in index.terms.collect()} == {(t, 1000, 3, 15) for t in "abcde"}
