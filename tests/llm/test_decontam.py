import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontam
from quillstone.llm.decontam import RADIUS, decontaminate, leaks

DOCS = "doc_key string, text string, doc_id long, item_id int, similarity double"
ITEMS = "text string, item_id long, doc_id long"


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def brute(docs, items):
    out = []
    for text, doc_id in {(d[1], d[2]) for d in docs}:
        for item_text, item_id, _ in items:
            want = grams(item_text)
            if not want:
                continue
            k = len(want[0])
            w = re.findall(r"[^\W_]+", (text or "").lower())
            have = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
            best = (0, 0)
            for s in range(max(1, len(have) - len(want) + 1)):
                window = have[s : s + len(want)]
                common = sum((collections.Counter(window) & collections.Counter(want)).values())
                best = max(best, (round(common / (len(want) + len(window) - common), 6), -s))
            if best[0] >= 0.8:
                out.append((doc_id, item_id, best[0]))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    word = lambda: "w%d" % rng.randrange(3000)
    items = [(" ".join(word() for _ in range(n)), n, 1) for n in (12, 20, 33, 60, 150)]
    items += [("two words", 900, 1), ("single", 901, 1), ("a b c d", 902, 1), (None, 903, 1), ("", 904, 1), ("!!", 905, 1), (items[0][0], 906, 1), ("r r r r r r r r", 907, 1)]
    docs = [("x", " ".join(word() for _ in range(rng.randint(5, 200))), i, 1, 0.0) for i in range(60)]
    for j in range(80):
        text = rng.choice(items[:5])[0].split()
        for _ in range(rng.randint(0, 2 + len(text) // 40)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[word()], [], [text[at], word()]])
        around = [word() for _ in range(rng.randint(0, 50))], [word() for _ in range(rng.randint(0, 50))]
        docs.append(("x", (", " if j % 2 else " ").join([*around[0], *text, *around[1]]).upper(), 100 + j, 1, 0.0))
    docs += [("x", None, 300, 1, 0.0), ("x", "", 301, 1, 0.0), ("x", "here are two words", 302, 1, 0.0), ("x", "a b c d", None, 1, 0.0), ("x", "r " * 30, 303, 1, 0.0), docs[70], docs[70]]
    docs += [("x", "filler " * 20_000 + items[2][0], 304, 1, 0.0), ("x", (items[1][0] + " ") * 50, 305, 1, 0.0), ("x", items[3][0], 7, 1, 0.0)]
    return docs, items


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_matches_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = sorted(((r.doc_id, r.item_id, r.similarity) for r in leaks(df, bench).collect()), key=repr)
    assert got == brute(docs, items) and len(got) > 40


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, DOCS)
    bad = {(d, ) for d, _, _ in brute(docs, items)}
    kept = decontaminate(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(d[2]) for d in docs if (d[2],) not in bad or (d[2] == 7 and d[1] != items[3][0]))


def test_empty_tables(spark):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame(items, ITEMS)
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0
    assert decontaminate(df, bench.limit(0)).count() == 5


def test_radius_holds_all_similar_windows(spark):
    """Of 3000 pairs of shingle sets at similarity 0.8 to 0.85, none is farther apart than the radius."""
    rng = random.Random(1)
    rows = []
    for pair in range(3000):
        m = rng.randint(9, 120)
        differ = int(m - 0.8 * 2 * m / 1.8)
        common = [rng.getrandbits(63) for _ in range(m - differ)]
        rows += [(pair, side, h) for side in (0, 1) for h in common + [rng.getrandbits(63) for _ in range(differ)]]
    prints = spark.createDataFrame(rows, "pair int, side int, h long").groupBy("pair", "side").agg(decontam.fingerprint("h", F.count(F.lit(1))).alias("f"))
    worst = prints.groupBy("pair").agg(F.bit_count(F.max(F.when(F.col("side") == 0, F.col("f"))).bitwiseXOR(F.max(F.when(F.col("side") == 1, F.col("f"))))).alias("d")).agg(F.max("d")).first()[0]
    assert worst <= RADIUS
