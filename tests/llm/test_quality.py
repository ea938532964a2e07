import numpy as np
from pyspark.sql import functions as F

from quillstone.llm.quality import fit_rules, keep_good, score_quality, statistics

SCHEMA = "doc_id long, text string, score string, y int"
LABELS = "doc_id long, quality int, text string"


def corpus():
    rng = np.random.default_rng(3)
    words = ["stone", "river", "of", "the", "light", "and", "house", "was", "in", "green"]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(words, int(rng.integers(20, 60)))) + "."
        bad = i % 4 == 0
        rows.append((i, text.replace(" ", "### ") if bad else text, "x", 9))
        labels.append((i, int(not bad), "clash"))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus()
    extra = [(1000, None, "x", 1), (1001, "", "x", 1), (None, "null id", "x", 1), (0, rows[0][1], "x", 1), (1002, "long " * 50_000, "x", 1)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = [*labels, (None, 1, "x"), (3, None, "x")]
    got = score_quality(spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame(labels, LABELS), held_out=held).toPandas()
    assert len(got) == len(rows) + len(extra)
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    truth = {i: q for i, q, _ in labels}
    test = got[got["held_out"] & (got["doc_id"] < 400)]
    assert len(test) > 50 and (test["predicted"] == test["doc_id"].map(truth)).mean() > 0.97
    assert got.loc[got["doc_id"] == 0, "score"].nunique() == 1
    assert not got.loc[got["doc_id"].isna(), "held_out"].any()


def test_without_labels(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows[:3], SCHEMA)
    assert {r.score for r in score_quality(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    one = score_quality(docs, spark.createDataFrame([(1, 1, "x")], LABELS)).collect()
    assert all(r.score > 0.99 for r in one)
    assert score_quality(docs.limit(0), spark.createDataFrame([], LABELS)).count() == 0


def test_rules_are_sparse_and_compile_to_what_numpy_computes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] <= 0.8)).astype(float)
    names = list("abcd")
    model = fit_rules(x, y, names)
    assert 0 < len(model.rules) < 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:300]], ",".join(f"{n} double" for n in names))
    got = np.array([r.s for r in df.select(model.score().alias("s")).collect()])
    total = np.full(300, model.bias)
    for rule in model.rules:
        holds = np.ones(300, bool)
        for name, side, bound in rule.terms:
            column = x[:300, names.index(name)]
            holds &= column <= bound if side == "<=" else column > bound
        total += rule.weight * holds
    assert np.allclose(got, 1 / (1 + np.exp(-total))) and ((got > 0.5) == y[:300]).mean() > 0.97


def test_statistics_of_empty_text_are_zero(spark):
    row = spark.createDataFrame([("",)], "text string").select(*[c.alias(n) for n, c in statistics(F.col("text")).items()]).first()
    assert all(v == 0 for v in row)


def test_keep_good_with_clashing_columns(spark):
    rows, labels = corpus()
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", rk int")
    kept = keep_good(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, q, _ in labels if q}
