"""Quality classifier: a sparse rule ensemble compiled to a Spark column expression.

Statistics of the whole text are plain column expressions. Small boosted trees are grown in numpy on a bounded
sample of labelled rows (``MAX_SAMPLE``, drawn by a hash of their id); every path from a root to a
node is a conjunctive rule. A logistic model with an L1 penalty weighs the rules, most weights become zero, and
the rest is written out as ``sigmoid(bias + sum(weight * rule))`` over the statistics, evaluated by the JVM.

Defined results. Null text is the empty text: all its statistics are 0, and it gets a score like any other. A null
id is never held out and never learned from. Repeated rows are scored alike, one result each; several labels of
one id are all learned from. Rows with a null label are no labels. Without labels of both classes the score is the
rate of label 1, or 0.5 without any label. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch, free_name

MAX_SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK, LASSO, ROUNDS = 40, 3, 32, 0.3, 0.002, 400
SPLIT = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Name to expression; every one is 0 for the empty text. Ratios are per character, word or line."""
    def per(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    chars = F.length(text)
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "chars": chars.cast("double"),
        "words": F.size(words).cast("double"),
        "lines": F.size(lines).cast("double"),
        "letters_a_word": per(chars, F.size(words)),
        "words_a_line": per(F.size(words), F.size(lines)),
        "different_words": per(F.size(F.array_distinct(words)), F.size(words)),
        "different_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "capitals": per(count("[A-Z]"), chars),
        "digits": per(count("[0-9]"), chars),
        "marks": per(count(r"[#$%&*|!{}<>=_~^@\\/]"), F.size(words)),
        "stops": per(count(r"[.?](\s|$)"), F.size(words)),
        "commas": per(count(","), F.size(words)),
        "short_words": per(count(r"(?<!\S)\p{L}{1,3}(?!\S)"), F.size(words)),
    }


@dataclass(frozen=True)
class Rule:
    """All of ``terms`` (statistic, "<=" or ">", bound) hold."""

    terms: tuple[tuple[str, str, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = None
        for name, side, bound in self.terms:
            term = F.col(name) <= F.lit(bound) if side == "<=" else F.col(name) > F.lit(bound)
            out = term if out is None else out & term
        return out


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1, as an expression over the statistics' columns."""
        total = F.lit(self.bias)
        for r in self.rules:
            total = total + F.when(r.column(), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(codes: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int, path: tuple, features: np.ndarray, least: int, found: list, out: np.ndarray) -> None:
    """Split ``rows`` by the code bound that lowers the squared error most; collects each node's path."""
    if path:
        found.append(path)
    best = (1e-9, -1, 0)
    if depth and len(rows) >= 2 * least:
        r, n = residual[rows], len(rows)
        whole = r.sum() ** 2 / n
        for f in features:
            c = codes[rows, f]
            counts, sums = np.bincount(c, minlength=BINS).cumsum()[:-1], np.bincount(c, r, BINS).cumsum()[:-1]
            ok = (counts >= least) & (n - counts >= least)
            if ok.any():
                gain = np.where(ok, sums**2 / np.maximum(counts, 1) + (r.sum() - sums) ** 2 / np.maximum(n - counts, 1) - whole, 0)
                if gain.max() > best[0]:
                    best = (float(gain.max()), int(f), int(gain.argmax()))
    if best[1] < 0:
        out[rows] = residual[rows].mean() if len(rows) else 0
        return
    _, f, at = best
    low = codes[rows, f] <= at
    for side, part in (("<=", rows[low]), (">", rows[~low])):
        _grow(codes, residual, part, depth - 1, (*path, (f, side, at)), features, least, found, out)


def _paths(codes: np.ndarray, y: np.ndarray, seed: int) -> list[tuple]:
    rng, found, margin = np.random.default_rng(seed), [], np.zeros(len(y))
    least = max(5, len(y) // 200)
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        features = rng.choice(codes.shape[1], max(1, codes.shape[1] * 2 // 3), replace=False)
        step, paths = np.zeros(len(y)), []
        _grow(codes, residual, rows, DEPTH, (), features, least, paths, step)
        found += paths
        margin += SHRINK * 4 * step
    return list(dict.fromkeys(tuple(sorted(set(p))) for p in found))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> RuleModel:
    """Rules from boosted trees, weighed by proximal gradient steps on the L1-penalised logistic loss."""
    if len(y) == 0 or y.min() == y.max():
        rate = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return RuleModel(float(np.log(rate / (1 - rate))), ())
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], 1)
    paths = [p for p in _paths(codes, y, seed) if all(at < len(bounds[f]) for f, _, at in p)]
    hold = np.ones((len(y), len(paths)), np.float32)
    for k, p in enumerate(paths):
        for f, side, at in p:
            hold[:, k] *= codes[:, f] <= at if side == "<=" else codes[:, f] > at
    mean = hold.mean(0)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-4)).astype(np.float32)
    z = (hold - mean) / spread
    w, bias, v, vb, t = np.zeros(z.shape[1], np.float32), 0.0, np.zeros(z.shape[1], np.float32), 0.0, 1.0
    u = np.ones(z.shape[1], np.float32)
    for _ in range(8):  # largest eigenvalue of the Gram matrix bounds the step
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u)
    rate = 4 * len(y) / (1.05 * float(np.linalg.norm(z @ u) ** 2) + len(y))
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(z @ v + vb))) - y
        moved = v - rate * (z.T @ error).astype(np.float32) / len(y)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * LASSO, 0)
        new_bias, grown = vb - rate * float(error.mean()), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / grown * (new - w), new_bias + (t - 1) / grown * (new_bias - bias)
        w, bias, t = new, new_bias, grown
    keep = [k for k in range(len(paths)) if abs(w[k]) > 1e-4]
    rules = tuple(Rule(tuple((names[f], side, float(bounds[f][at])) for f, side, at in paths[k]), float(w[k] / spread[k])) for k in keep)
    return RuleModel(float(bias - sum(w[k] * mean[k] / spread[k] for k in keep)), rules)


def fit(featured: DataFrame, labels: DataFrame, names: list[str], *, max_sample: int = MAX_SAMPLE) -> RuleModel:
    """Fit on at most ``max_sample`` rows of ``featured`` (doc_id and statistics) joined with ``labels`` (doc_id, y)."""
    known = featured.join(labels, "doc_id").withColumn("draw", F.xxhash64("doc_id"))
    total = known.count()
    if total > max_sample:  # leave about a fifth more than needed, so that little is sorted and sent
        known = known.where(F.pmod("draw", F.lit(1_000_003)) < 1_000_003 * 1.2 * max_sample / total)
    sample = known.orderBy("draw", "doc_id", "y").limit(max_sample).toPandas()
    return fit_rules(sample[names].to_numpy(float).reshape(-1, len(names)), sample["y"].to_numpy(float), names)


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: Column | None = None, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """One row per document: doc_id, rk (a hash of id and text), held_out, score."""
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    stats = statistics(F.coalesce(F.col(text_col), F.lit("")))
    scratch = Scratch(docs.sparkSession, "quality")
    # Written once: the text is read a single time, and the long score expression works on plain columns.
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk")
    featured = scratch.table("statistics", docs.select(F.col(id_col).alias("doc_id"), key, *[c.alias(n) for n, c in stats.items()]))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held)
    model = fit(featured, known, list(stats), max_sample=max_sample)
    return featured.select("doc_id", "rk", held.alias("held_out"), model.score().alias("score"))


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Options are those of ``scored``; ``held_out`` is a condition on ``doc_id``."""
    found = scored(docs, labels, **options)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """``docs`` without those that score below ``least``; columns and repeated rows are kept."""
    key = free_name(docs, "rk")
    bad = scored(docs, labels, id_col=id_col, text_col=text_col, **options).where(F.col("score") < least).select(F.col("rk").alias(key)).distinct()
    marked = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    return marked.join(bad.hint("shuffle_hash"), key, "left_anti").select(*docs.columns)
