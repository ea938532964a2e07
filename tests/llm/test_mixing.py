import collections

from pyspark.sql import functions as F

from quillstone.llm.mixing import mix, position, schedule, targets

SCHEMA = "doc_id long, text string, source string, taken long, position string"


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Brute-force water filling: raise the level source by source."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def corpus(spark):
    rows = [(i, " ".join(["w"] * (i % 23)), "hot" if i % 3 == 0 else f"s{i % 7}", 1, "x") for i in range(700)]
    rows += [(None, "null id here", "s1", 1, "x"), (5, None, None, 1, "x"), (6, "a b c", None, 1, "x"), (7, "same row", "s2", 1, "x"), (7, "same row", "s2", 1, "x"), (8, "word " * 30_000, "s3", 1, "x"), (9, " \t\n", "empty", 1, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_targets_and_taken(spark):
    rows, df = corpus(spark)
    got = mix(df).toPandas()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = fill(dict(sizes))
    total = collections.Counter()
    source_of = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    for r in got.itertuples():
        source = source_of[(None if r.doc_id != r.doc_id else int(r.doc_id), r.size)]
        assert abs(r.target - want[source]) < 1e-6 and r.source_size == sizes[source]
        assert 0 <= r.taken <= 3 * r.size
        total[source] += r.taken
    assert all(abs(total[s] - want[s]) <= 0.5 for s in want)
    again = mix(df.repartition(5)).toPandas()
    assert sorted(map(repr, got.itertuples(index=False))) == sorted(map(repr, again.itertuples(index=False)))


def test_schedule_keeps_columns_and_order(spark):
    rows, df = corpus(spark)
    clash = df.withColumns({n: F.col("taken") for n in ("lists", "key", "nth", "positions")})
    out = schedule(clash)
    assert out.columns == [*clash.columns, "_position"]
    got = out.toPandas()
    assert got["_position"].between(0, 1).all() and got["_position"].is_monotonic_increasing
    assert {(repr(r.doc_id), r.position, r.lists) for r in clash.collect() if r.text} >= {(repr(None if d != d else int(d)), p, n) for d, p, n in zip(got.doc_id, got.position, got.lists)}
    assert schedule(df.drop("position")).columns == ["doc_id", "text", "source", "taken", "position"]
    taken = mix(df).groupBy("doc_id", "size").agg(F.sum("taken").alias("t"), F.count("*").alias("n")).collect()
    copies = collections.Counter((None if d != d else int(d), len((t or "").split())) for d, t in zip(got.doc_id, got.text))
    for r in taken:
        if r.size:
            assert abs(copies[(r.doc_id, r.size)] - r.t / r.size) <= 0.5 * r.n


def test_schedule_is_inverted(spark):
    knots = ((0.0, 2.0), (0.25, 1.0), (1.0, 0.0))
    got = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", position(F.col("u"), F.lit(0), (knots,)).alias("t")).collect()

    def integral(t):
        a = min(t, 0.25)
        head = a * (2.0 + (2.0 - 4 * a)) / 2
        b = max(0.0, t - 0.25)
        return (head + b * (1.0 + (1.0 - b / 0.75)) / 2) / (0.375 + 0.375)

    assert all(abs(integral(r.t) - r.u) < 1e-9 for r in got)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == 0 and schedule(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a", 1, "x")], SCHEMA)
    assert [(r.taken, r.target) for r in mix(blank).collect()] == [(0, 0.0)]
    assert targets(blank.selectExpr("source", "0L size")).count() == 1
