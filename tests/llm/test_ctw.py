import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ctw
from quillstone.llm.ctw import DEPTH, SPLITS, Tree, log_gamma, message_of, owner_of_grams, score_texts, second_level, upper_levels, words_of

SCHEMA = "score double, text string, doc_id long, chunk string"


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)


class Brute:
    """The tree by recursion over dictionaries: contexts nearest byte first, decisions by (bits so far)."""

    def __init__(self, messages):
        self.counts = collections.defaultdict(lambda: [0, 0])
        self.children = collections.defaultdict(set)
        for m in messages:
            s = b"\n" * DEPTH + m
            for i in range(DEPTH, len(s)):
                ctx = s[i - DEPTH : i][::-1]
                for j in range(8):
                    node = (1 << j) | (s[i] >> (8 - j))
                    for d in range(DEPTH + 1):
                        self.counts[ctx[:d], node][(s[i] >> (7 - j)) & 1] += 1
                        if d < DEPTH:
                            self.children[ctx[:d], node].add(ctx[: d + 1])
        self.memo = {}

    def pw(self, ctx, node):
        if (ctx, node) not in self.counts:
            return 0.0
        if (ctx, node) not in self.memo:
            own = kt(*self.counts[ctx, node])
            if len(ctx) < DEPTH:
                below = sum(self.pw(c, node) for c in self.children[ctx, node])
                top = max(own, below)
                own = math.log(0.5) + top + math.log(math.exp(own - top) + math.exp(below - top))
            self.memo[ctx, node] = own
        return self.memo[ctx, node]

    def one(self, ctx, node, d):
        a, b = self.counts[ctx[:d], node] if (ctx[:d], node) in self.counts else (0, 0)
        own = (b + 0.5) / (a + b + 1)
        if d == DEPTH:
            return own
        w = 0.5 * math.exp(kt(a, b) - self.pw(ctx[:d], node))
        return w * own + (1 - w) * self.one(ctx, node, d + 1)

    def log10(self, m):
        s, total = b"\n" * DEPTH + m, 0.0
        for i in range(DEPTH, len(s)):
            ctx = s[i - DEPTH : i][::-1]
            for j in range(8):
                p = self.one(ctx, (1 << j) | (s[i] >> (8 - j)), 0)
                total += math.log10(p if (s[i] >> (7 - j)) & 1 else 1 - p)
        return total


def corpus():
    rng = random.Random(4)
    words = ["the", "THE", "shore", "lights", "ère", "of", "日本", "x1"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), i) for i in range(60)]
    return rows + [(None, 100), ("", 101), (" \t\n\x0b", 102), ("same", 103), ("same", 103), ("nul id", None), ("\x1c\x85 odd\x0cspace", 104), ("unseen " * 300, 110)]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def brute(rows):
    texts = [(words_of((t or "").encode()), d) for t, d in rows]
    train = [w for w, d in texts if not held(d)]
    counts = collections.Counter()
    for w in train:
        counts.update([*w, None])
    total, distinct, tree = sum(counts.values()), len(counts), Brute([message_of(w) for w in train])
    out = []
    for w, d in texts:
        base = sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in [*w, None])
        out.append((repr(d), held(d), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), total, round(base, 6), tree.log10(message_of(w))))
    return sorted(out)


@pytest.mark.parametrize("segment", [7, 64, 1 << 20])
def test_cut_messages_keep_their_context(segment, monkeypatch):
    """Cutting long messages into segments changes neither the pairs nor the documents they belong to."""
    messages = [message_of(words_of((t or "").encode())) for t, _ in corpus()]
    want = collections.Counter()
    for doc, m in enumerate(messages):
        s = b"\n" * DEPTH + m
        want.update((doc, s[i - DEPTH : i][::-1] + s[i : i + 1]) for i in range(DEPTH, len(s)))
    monkeypatch.setattr(ctw, "SEGMENT_BYTES", segment)
    got = collections.Counter()
    for docs, combined in ctw.segments(messages):
        got.update((int(docs[c & 0xFFFF]), (c >> 16).to_bytes(DEPTH + 1, "big")) for c in combined.tolist())
    assert got == want


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(0.5, t, d, "x") for t, d in rows], SCHEMA).repartition(3)
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in score_texts(df).collect())
    want = brute(rows)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert all(abs(g[6] - w[6]) < 1e-6 for g, w in zip(got, want))


def test_without_training_texts_and_empty(spark):
    only = [d for d in range(200) if held(d)][:2]
    df = spark.createDataFrame([(0.5, "abc", d, "x") for d in only], SCHEMA)
    got = score_texts(df).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.bits_per_byte - 8) < 1e-6 for r in got)
    assert score_texts(df.limit(0)).count() == 0


def test_probabilities_of_the_next_byte_sum_to_one():
    rng = np.random.default_rng(3)
    contexts = np.unique(rng.integers(97, 101, (40, DEPTH)), axis=0).astype(np.uint64)
    context = sum(contexts[:, k] << np.uint64(8 * (DEPTH - k)) for k in range(DEPTH))
    keys = np.sort((context[:, None] | np.arange(256, dtype=np.uint64)).ravel())
    counts = (rng.random(len(keys)) < 0.05) * rng.integers(1, 50, len(keys))
    owners = owner_of_grams(keys, 4 * SPLITS)
    trees = {o: Tree(keys[owners == o], counts[owners == o]) for o in np.unique(owners).tolist()}
    second, above = {}, collections.defaultdict(lambda: np.zeros(3))
    for group in {o // SPLITS for o in trees}:
        second[group], up = second_level([t.upward() for o, t in trees.items() if o // SPLITS == group])
        for name, *sums in zip(*up):
            above[name] += sums
    upper, p = upper_levels([(k, *v) for k, v in above.items()]), np.empty(len(keys))
    for o, tree in trees.items():
        p[owners == o] = 10 ** tree.log10(second[o // SPLITS], upper)
    assert np.allclose(p.reshape(-1, 256).sum(1), 1)


def test_held_out_structure_is_learned(spark):
    """Three bits a syllable, and its ends, which come at one of six boundaries, are beyond the depth: 21.9 bits a word."""
    rng = random.Random(9)
    parts = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti"]
    rows = [(0.5, " ".join("".join(rng.choices(parts, k=6)) for _ in range(80)), i, "x") for i in range(400)]
    got = [r for r in score_texts(spark.createDataFrame(rows, SCHEMA)).collect() if r.held_out]
    bits = -sum(r.score for r in got) * math.log2(10) / sum(r.n_bytes for r in got)
    assert 21.9 / 13 * 0.97 < bits < 21.9 / 13 * 1.04


def test_very_long_text(spark):
    """A text of several segments: each further repetition of its words adds the same."""
    n = 500_000
    rows = [(0.5, "x1 the " * k, d, "x") for k, d in ((50, 500), (51, 501), (n, 502))]
    train = [(0.5, t, i, "x") for i, t in enumerate(["the x1 the shore", "x1 the x1"] * 20) if not held(i)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows + train, SCHEMA), held_out=F.col("doc_id") >= 500).collect()}
    assert got[502].n_tokens == 2 * n + 1
    step = got[501].score - got[500].score
    assert abs(got[502].score / (got[500].score + (n - 50) * step) - 1) < 1e-9


def test_rows_grow_with_the_chunks_alone():
    """A frequent pair of bytes is dealt to several owners, whose number does not depend on the input."""
    keys = np.array([int.from_bytes(b"e " + bytes([c]) + b"ab!", "big") for c in range(97, 123)], np.uint64)
    owners = owner_of_grams(keys, 64 * SPLITS)
    assert len(set(owners.tolist())) > SPLITS // 2 and len(set((owners // SPLITS).tolist())) == 1


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.5, 10.5, 1000.5, 1e6, 1e9 + 0.5])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
