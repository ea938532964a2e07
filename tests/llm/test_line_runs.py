import random

import pytest

from quillstone.llm.line_runs import line_runs

SCHEMA = "rid string, text string, doc_id long, line int, starts string"
WS = " \t\n\x0b\x0c\r"


def brute(rows, m):
    """Rows in order of (id, position); windows of m lines that were seen before lose their lines."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1] is not None, rows[i][1] or 0, rows[i][0] or ""))
    seen, out = set(), []
    for i in order:
        lines = (rows[i][0] or "").split("\n")
        used = [k for k, x in enumerate(lines) if x.strip(WS)]
        gone = set()
        for s in range(len(used) - m + 1):
            window = tuple(lines[k] for k in used[s : s + m])
            if window in seen:
                gone.update(range(s, s + m))
            seen.add(window)
        kept = "\n".join(x for k, x in enumerate(lines) if not (k in used and used.index(k) in gone))
        out.append((repr(rows[i][1]), len(lines), len(gone), sum(g - 1 not in gone for g in gone), kept))
    return sorted(out)


def corpus():
    rng = random.Random(7)
    line = lambda: "line %d" % rng.randrange(60)
    blocks = [[f"block {b} line {k}" for k in range(rng.randint(2, 9))] for b in range(8)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice([rng.choice(blocks), [line()], ["", " \t"], ["header"], rng.choice(blocks)[1:]])
        rows.append(("\n".join(lines), i))
    rows += [(None, 500), ("", 501), ("a\na\na\na\na", 502), ("header\n\n\nline 1", 503), ("tail\n", 504), ("same\nrow\nhere", 505), ("same\nrow\nhere", 505), ("same\nrow\nhere", None), ("\r\n\n\x0b", 506), ("long line " * 30_000 + "\nx", 507)]
    return rows


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5])
def test_matches_brute_force(spark, m):
    rows = corpus()
    df = spark.createDataFrame([("x", t, d, 1, "x") for t, d in rows], SCHEMA).repartition(3)
    got = sorted((repr(r.doc_id), r.n_lines, r.n_removed, r.n_runs, r.kept) for r in line_runs(df, min_lines=m).collect())
    assert got == brute(rows, m)


def test_empty(spark):
    assert line_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_single_lines(spark):
    """A line of more than 50 words goes where it occurred before, also alone in its document; shorter ones stay."""
    long, short = " ".join(f"w{k}" for k in range(51)), " \t".join(f"w{k}" for k in range(50))
    texts = [f"a\n{long}\nb", f"c\n{long}\nd", long, f"\n{long}\n{long}", short, f"e\n{short}", f"x\n{long}", f"y\nx\n{long}\nz", f"{long} more"]
    df = spark.createDataFrame([("x", t, i, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept) for r in line_runs(df).collect()}
    assert got == {
        0: (3, 0, 0, texts[0]), 1: (3, 1, 1, "c\nd"), 2: (1, 1, 1, ""), 3: (3, 2, 1, ""), 4: (1, 0, 0, short),
        5: (2, 0, 0, texts[5]), 6: (2, 1, 1, "x"), 7: (4, 2, 1, "y\nz"), 8: (1, 0, 0, texts[8]),
    }
