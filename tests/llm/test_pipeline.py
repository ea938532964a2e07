import collections
import random
import re

import pytest

import corpus_pipeline
from quillstone.llm.mixing import mix
from quillstone.llm.near_dup import keep_one

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra"]) for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(40) for _ in range(5)]
    rows, labels = [], []
    for i in range(300):
        t = text(rng.randint(30, 120))
        bad = i % 5 == 0
        rows.append([i, t.replace(" ", "### ") if bad else t])
        labels.append((i, int(not bad), 0))
    rows += [[400 + k, rows[4 * k + 1][1]] for k in range(10)]
    for k in range(10):
        near = rows[4 * k + 2][1].split() + text(60).split()
        rows += [[500 + k, " ".join(near)], [600 + k, " ".join([*near[:-1], "changed"])]]
    rows += [[700 + k, text(20) + " " + items[k % 5] + " " + text(20)] for k in range(12)]
    rows += [[800, None], [801, ""], [None, text(50)], [900, text(50)]]
    rows.append(list(rows[-1]))
    rows = [(i, t, "en", f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(rows)]
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, corpus):
    d, rows, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
        outs[name] = docs.collect()
    for name in ("quality", "near_duplicates", "decontamination", "mixing"):
        assert set(outs[name][0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    good = collections.Counter(tuple(r) for r in outs["quality"])
    assert not any("###" in (r[1] or "") for r in good)
    assert all(good[r] == n for r, n in collections.Counter(rows).items() if "###" not in (r[1] or "") and len(grams(r[1])) > 20)

    # Brute force on what each stage was given.
    kept = [tuple(r) for r in outs["quality"]]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    group, sets = list(range(len(kept))), [grams(r[1]) for r in kept]
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = collections.Counter(kept[i] for i in range(len(kept)) if group[i] == i or not sets[i])
    assert collections.Counter(tuple(r) for r in outs["near_duplicates"]) == want

    leaking = lambda t: any(it in " ".join(re.findall(r"[^\W_]+", (t or "").lower())) for it in items)
    clean = collections.Counter(r for r in want.elements() if not leaking(r[1]))
    assert collections.Counter(tuple(r) for r in outs["decontamination"]) == clean

    given = spark.createDataFrame(list(clean.elements()), SCHEMA)
    taken = {(r.doc_id, r.size): r.taken for r in mix(given).collect()}
    copies = collections.Counter(tuple(r) for r in outs["mixing"])
    assert set(copies) <= set(clean)
    for row in clean:
        size = len((row[1] or "").split())
        assert copies[row] == (0 if not size else int(taken[row[0], size] / size + 0.5))

    out = sorted(outs["token_ids"], key=lambda r: r.start)
    assert len(out) == sum(copies.values())
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]


def test_run_applies_all_stages(spark, corpus):
    d, _, _ = corpus
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50


def test_keep_one_with_shared_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "other text under the same id", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "A B C D E F G", "en", "s", 1), (3, "", "en", "s", 1), (3, "", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1)]
    got = sorted((repr(r.doc_id), r.text) for r in keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", "a b c d e f g"), ("1", "other text under the same id"), ("3", ""), ("3", "")]


def test_stages_take_odd_tables(spark, corpus, tmp_path):
    """A very long text, nulls and columns with the helpers' names go through all stages; so does an empty table."""
    d, rows, _ = corpus
    rng = random.Random(5)
    long = " ".join(rng.choice(["ba", "ke", "lo", "mira", "nuke"]) + str(k % 977) for k in range(40_000))
    some = [*rows[1:40:3], (950, long, None, None, None), (951, None, "en", "s1", 0), (None, "", None, "s2", 0)]
    names = {"rk": "rid", "node": "score", "position": "h", "start": "taken"}
    docs = spark.createDataFrame(some, SCHEMA).selectExpr("*", *[f"doc_id AS {a}" for a in names], *[f"lang AS {b}" for b in names.values()])
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, d).cache(), stage(spark, empty, d).cache()
        assert empty.count() == 0 and docs.count() > 5
        if name == "token_ids":
            assert docs.where("doc_id = 950").count() >= 1
        else:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars", *names, *names.values()}
            assert docs.where("doc_id = 950").first().text == long
