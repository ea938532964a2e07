import collections
import hashlib
import random

import numpy as np
import pytest

from quillstone.llm import substrings
from quillstone.llm.deep_shallow import common, deep_shallow
from quillstone.llm.substrings import LENGTH, remove_repeats, repeated_windows

SCHEMA = "kept string, text string, doc_id long, rk long, chunk int"


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + LENGTH] for r in raws for i in range(len(r) - LENGTH + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(copies=12):
    rng = random.Random(12)
    words = ["w%d" % i for i in range(900)] + ["été", "日本語"]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, boiler = draw(160), draw(95)
    texts = [draw(rng.randint(1, 300)) for _ in range(30)]
    for _ in range(copies):
        texts.append(draw(rng.randint(0, 60)) + " " + passage + " " + draw(rng.randint(0, 60)))
        texts.append(draw(40) + boiler[rng.randint(0, 60) :] + draw(40))
        near = passage.split() + draw(80).split()
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += ["ab" * 700, "a" * 1500, "a" * 399, "a" * 400, None, "", passage[:LENGTH], passage[1:LENGTH], draw(200), "x" + passage + passage]
    exact = draw(180)
    return texts + [exact, exact, draw(100) + "\0\n" + exact[100:900]]


@pytest.mark.parametrize(("hot", "pairwise"), [(20_000, 64), (20_000, 1), (3, 64)])
def test_matches_brute_force(spark, hot, pairwise, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "PAIRWISE", pairwise)
    texts = corpus()
    df = spark.createDataFrame([("x", t, i if i % 9 else None, 1, 1) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect())
    assert got == sorted(brute(texts))


def test_long_texts_are_cut_into_pieces(spark):
    rng = random.Random(3)
    block = "".join(rng.choice("abcdefgh \n") for _ in range(3000))
    long = "".join(rng.choice("ijklmnop \n") for _ in range(2_200_000))
    long = long[:1_047_000] + block + long[1_047_000:]
    rows = [("x", long, 1, 1, 1), ("x", block[500:], 2, 1, 1), ("x", long, 3, 1, 1)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows[:2], SCHEMA), with_bytes=False).collect()}
    assert got == {1: (2500, 1), 2: (2500, 1)}
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), with_bytes=False).collect()}
    assert got == {1: len(long), 2: 2500, 3: len(long)}


def test_repeated_rows_and_empty(spark):
    text = "".join(map(str, range(300)))
    df = spark.createDataFrame([("x", text, 1, 1, 1), ("x", text, 1, 1, 1)], SCHEMA)
    assert [(r.n_removed, r.kept) for r in remove_repeats(df).collect()] == [(len(text), b"")] * 2
    assert remove_repeats(df.limit(0)).count() == 0


def test_pairs_and_orders_agree():
    rng = random.Random(2)
    for trial in range(30):
        base = bytes(rng.choice(b"abcd") for _ in range(900))
        group = []
        for _ in range(rng.randint(2, 9)):
            body = bytearray(base)
            for _ in range(rng.randint(0, 2)):
                body[rng.choice([rng.randint(0, 380), rng.randint(430, 899)])] = 65
            m, lo = 400, rng.randint(20, 400)
            hi = rng.randint(lo, 400)
            group.append((lo, hi, m, True, bytes(body[lo : hi + LENGTH])))
        group = list({(g[0], g[1], g[4]): g for g in group}.values())
        windows = collections.defaultdict(set)
        for i, (lo, hi, m, _, body) in enumerate(group):
            for s in range(lo, hi + 1):
                windows[m - s, body[s - lo : s - lo + LENGTH]].add(i)
        want = {(i, s) for (d, _), who in windows.items() if len(who) > 1 for i in who for s in [400 - d]}
        for rows in (repeated_windows(group), substrings._by_orders(group)):
            assert {(i, s) for i, a, b in rows for s in range(a, b + 1)} == want


def test_deep_shallow_orders():
    rng = random.Random(1)
    for trial in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 30))]
        strings += [b"shared prefix of some length " + s for s in strings] + strings[:3]
        order, lcps = deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings)
        assert lcps == [0, *(common(strings[a], strings[b]) for a, b in zip(order, order[1:]))][: len(order)]
    assert common(b"abcX", b"abcY") == 3 and common(b"", b"a") == 0 and common(b"ab", b"ab") == 2
