"""Whole pools scored document by document equal the scores by pairs, and shuffle no pair."""

from pyspark.sql import functions as F

from quillstone.operators import pool_scores, ranking
from quillstone.plans.queries import QUERIES

DOCS = [(1, "a b b c", "en"), (2, None, "en"), (3, "c c d", None), (4, "a", "de"), (5, "x y", "en"), (6, "b a d", None)]
VECTORS = [(1, [0.0, 1.0]), (2, [2.0, 1.0]), (3, [0.5, 0.5]), (4, None), (5, [1.0, None]), (6, [3.0, 3.0]), (9, [1.0, 1.0])]
QUERIES_ = [(1, "a b zz"), (3, "c c"), (7, None)]


def test_equal_to_the_scores_by_pairs(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "id long, text string, lang string").withColumn("scope", F.struct("lang"))
    vectors, queries = spark.createDataFrame(VECTORS, "id long, embedding array<float>"), spark.createDataFrame(QUERIES_, "query_id long, query string")
    chunks = docs.select("id", F.when(F.col("id") % 2 == 0, "table_main").alias("chunk_nature"))
    own = vectors.withColumnRenamed("id", "query_id")
    scored, names = pool_scores.pool_scores(docs, queries.join(own, "query_id", "left"), vectors)
    scored.write.parquet(f"{tmp_path}/scored")
    got = pool_scores.fused_pools(spark.read.schema(scored.schema).parquet(f"{tmp_path}/scored"), names, chunks)
    asked = queries.crossJoin(docs.select("scope").distinct())
    bm25 = ranking.bm25_normalized(ranking.bm25_index(docs, "id", "text", "scope"), asked)
    v = vectors.join(docs.select("id", "scope"), "id").select(F.struct("id", "scope").alias("id"), "embedding")
    distances = ranking.vector_distances(v, queries.join(own, "query_id").select("query_id", "embedding")).select("query_id", "id.scope", "id.id", "distance")
    want = ranking.fuse(bm25, distances, chunks, bm25_weight=1.0, embedding_weight=1.0, scope="scope")
    listed = lambda df: sorted((r.query_id, r.id, str(r.scope), round(r.bm25_score, 9), round(r.embedding_score, 9), round(r.hybrid_score, 9)) for r in df.collect())
    assert listed(got) == listed(want) and len(listed(got)) == 18


def test_no_pair_is_shuffled(spark):
    plan = QUERIES["hybrid_fusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "SortMergeJoin" not in plan


def test_near_best_keeps_ties_and_the_best(spark):
    rows = spark.createDataFrame([(p, i, float(i % 7) + (1e-7 if i == 13 else 0.0)) for p in (1, 2) for i in range(100)], "pool int, id long, score double").coalesce(1)
    kept = pool_scores.near_best(rows, "score", 3)
    best = lambda df: sorted(tuple(r) for r in ranking.best(df, "score", 3, "pool").select("pool", "id", "rank").collect())
    assert best(kept) == best(rows) == [(p, i, n) for p in (1, 2) for n, i in ((1, 6), (2, 13), (3, 20))] and kept.count() < 20


def test_more_words_than_tasks_take_are_still_asked(spark, monkeypatch):
    run = lambda: sorted(map(tuple, QUERIES["hybrid_topk"](spark, "/root/testdata/sf0.001").collect()), key=str)
    by_documents = run()
    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 50)
    assert run() == by_documents


def test_best_of_pools_equal_the_stored_index_in_small_blocks(spark, tmp_path, monkeypatch):
    from quillstone.operators import term_index

    docs = [(i, " ".join(f"w{(i * j * j + j) % (5 + i % 9)}" for j in range(i % 11)), "ab"[i % 2] if i % 3 else None) for i in range(120)] + [(120, None, "a"), (121, " w1\tw1\n ", "b")]
    docs = spark.createDataFrame(docs, "id long, text string, lang string").withColumn("scope", F.struct("lang"))
    queries = spark.createDataFrame([(1, "w0 w1 w1 w7"), (2, "w12"), (3, "zz"), (4, None)], "query_id long, query string")
    term_index.write_batch(docs, f"file://{tmp_path}/terms", 0, id_col="id", text_col="text", scope_col="scope", buckets=4)
    index, every = term_index.load(spark, f"file://{tmp_path}/terms", 4), queries.crossJoin(docs.select("scope").distinct())
    listed = lambda df: sorted(map(repr, df.select("query_id", "scope", "rank", "id", *[F.round(c, 5) for c in df.columns if c.endswith("score")]).collect()))
    monkeypatch.setattr(pool_scores, "BLOCK", 40)
    monkeypatch.setattr(pool_scores, "ADDED", 7)
    few = docs.coalesce(1)
    assert listed(pool_scores.pool_search(few, queries, 3)) == listed(ranking.bm25_search(index, every, 3))
    assert listed(pool_scores.pool_topk(few, queries, 3)) == listed(ranking.bm25_topk(index, every, 3))


def test_searches_shuffle_neither_pairs_nor_postings(spark):
    for name in ("bm25_topk", "bm25_search"):
        found = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan and "bucket" not in plan
