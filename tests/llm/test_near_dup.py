import random

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import near_dup
from quillstone.llm.near_dup import EDGES, MAX_DEPTH, MIN_DEPTH, REGION_ROWS, link_family, linked, keep_one, near_duplicates, trees_for

SCHEMA = "component_id string, text string, doc_id long, family int"


def shingles(text, size):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted((repr(d), len(sets[i]), repr(least[find(i)]), d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ünï", "ÇA", "日本"]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for c in range(rng.randint(1, 14)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((1000 + 37 * g - c * 5, (" ".join(text)).upper() if c % 5 == 0 else "\n".join(text)))
    hub = ["h%d" % i for i in range(120)]
    for c in range(60):  # each near the hub, few near one another
        text = list(hub)
        for k in range(3):
            text[(c * 2 + 40 * k) % 120] = "x%d" % c
        rows.append((5000 + c, " ".join(text)))
    rows.append((5999, " ".join(hub)))
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "two  words"), (8, "a b c"), (9, "a b c"), (9, "a b c"), (9, "other text with the same id here"), (None, "a b c"), (None, "only null ids hold this"), (None, "only null ids hold this"), (10, "long " * 40_000)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_matches_brute_force(spark, size, percent):
    rows = corpus()
    df = spark.createDataFrame([("x", t, d, 1) for d, t in rows], SCHEMA).repartition(5)
    got = near_duplicates(df, size=size, percent=percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == brute(rows, size, percent)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_large_families_in_blocks(spark, size, percent, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    monkeypatch.setattr(near_dup, "FIRST_HUBS", 2)
    monkeypatch.setattr(near_dup, "HUBS", 8)
    rows = corpus()
    df = spark.createDataFrame([("x", t, d, 1) for d, t in rows], SCHEMA).repartition(5)
    got = near_duplicates(df, size=size, percent=percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id), r.kept) for r in got) == brute(rows, size, percent)


@pytest.mark.parametrize("tail", [0, 25, 10**6])
def test_components_by_rounds_and_tail(spark, monkeypatch, tail):
    """A path, a star and random edges: the same components, whether rounds or one task close them."""
    monkeypatch.setattr(near_dup, "TAIL", tail)
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(20)] + [tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(35)]
    want = {n: {n} for pair in pairs for n in pair}
    for a, b in pairs:
        if want[a] is not want[b]:
            want[a] |= want[b]
            for n in want[b]:
                want[n] = want[a]
    edges = spark.createDataFrame([(b"%03d" % a, b"%03d" % b) for a, b in set(pairs)], "a binary, b binary")
    got = near_dup.components(edges, near_dup.Scratch(spark, "test")).collect()
    found = {}
    for r in got:
        found.setdefault(bytes(r.label), set()).add(int(bytes(r.node)))
    assert len(got) == len(want) and all(int(label) in nodes and want[int(label)] == nodes for label, nodes in found.items())


def test_no_edges_have_no_components(spark):
    assert near_dup.components(spark.createDataFrame([], "a binary, b binary"), near_dup.Scratch(spark, "test")).count() == 0


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([("x", None, 3, 1)], SCHEMA)).collect()] == [(3, 0, 3, True)]


def test_link_family_is_exact():
    rng = np.random.default_rng(2)
    for trial in range(60):
        pool = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = [np.unique(rng.choice(pool[: rng.integers(8, 40)], rng.integers(3, 30))) for _ in range(rng.integers(1, 30))]
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        got = link_family(np.concatenate(sets), offsets, 60)
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 60 * len(a | b):
                    x, y = want[i], want[j]
                    want = [y if v == x else v for v in want]
        assert len({*zip(want, got.tolist())}) == len(set(want)) == len(set(got.tolist()))


def test_depth_adapts_to_the_region():
    small = [4] * (REGION_ROWS - 1)
    large = [4] * REGION_ROWS
    assert linked(np.array([*small, 0, *large, 3, 6, 4])).tolist() == [True] * len(small) + [False] * (len(large) + 2) + [True, True]
    # A large region is cut at the next depth: its small parts are linked there, its large ones at the greatest depth.
    part = [5] * REGION_ROWS
    assert linked(np.array([4, 5, 4, *part, 6, 6, 4, 5])).tolist() == [False, True, False, *[False] * len(part), True, True, False, True]


def test_neighbours_do_not_depend_on_batches():
    """A sorted order in batches of one row to all rows gives the same candidates as the regions of the whole order."""
    rng = np.random.default_rng(7)
    paths = [row.tobytes() for row in rng.integers(0, 3, (300, MAX_DEPTH)).astype(">u2")]
    nodes = [b"%016d" % k for k in range(300)]
    cut = [0] * 200 + [1] * 100
    paths = sorted(paths[:200]) + sorted(paths[200:])
    common = [next((d for d in range(MAX_DEPTH) if a[2 * d : 2 * d + 2] != b[2 * d : 2 * d + 2]), MAX_DEPTH) if x == y else 0 for a, b, x, y in zip(paths, paths[1:], cut, cut[1:])]
    want = {(nodes[k], nodes[k + 1]) for k in np.flatnonzero(linked(np.array(common)))}
    table = pa.table([pa.array(cut, pa.int32()), pa.array(paths, pa.binary()), pa.array(nodes, pa.binary())], names=["tree", "path", "node"])
    for size in (1, 2, 7, 50, 300):
        found = pa.Table.from_batches(near_dup._neighbours(iter(table.to_batches(max_chunksize=size))), schema=EDGES).to_pylist()
        assert {(r["a"], r["b"]) for r in found if r["kind"] == 0} == want
        assert [r["a"] for r in found if r["kind"] == 1] == [nodes[0]] and [r["a"] for r in found if r["kind"] == 2] == [nodes[-1]]


def test_trees_keep_the_miss_at_the_greatest_depth():
    for percent in (80, 85):
        share = (1 - (percent / 100) ** MAX_DEPTH) ** trees_for(percent)
        assert share <= near_dup.MISS and MIN_DEPTH < MAX_DEPTH


def test_keep_one_with_clashing_columns(spark):
    rows = [("a b c d e f", 1, 0, 0, 0, 0), ("a b c d e f", 2, 0, 0, 0, 0), ("", 3, 7, 7, 7, 7), ("", 3, 7, 7, 7, 7), (None, None, 1, 1, 1, 1), ("a b c d e f", 1, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "text string, doc_id long, rk int, one_of_group int, nth_of_row int, _rk int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[3], rows[4]], key=repr)


def test_texts_are_read_once_for_signatures_and_once_for_families(spark, monkeypatch, tmp_path):
    """Large families do not shuffle the texts of all documents once more."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    spark.createDataFrame([("x", t, d, 1) for d, t in corpus()], SCHEMA).write.parquet(f"{tmp_path}/texts")
    reads, table = {}, near_dup.Scratch.table

    def seen(self, name, df, *codec):
        reads.setdefault(name, any("/texts/" in f for f in df.inputFiles()))
        return table(self, name, df, *codec)

    monkeypatch.setattr(near_dup.Scratch, "table", seen)
    near_duplicates(spark.read.parquet(f"{tmp_path}/texts"), size=3, percent=85).collect()
    assert "sets" in reads and [n for n, r in reads.items() if r] == ["signed", "own"]
