"""Benchmark decontamination with DataFrame operations only: SimHash windows, multi-index Hamming blocks, exact check.

Words are runs of letters and digits, lower-cased; shingles are ``SHINGLE`` words (an item with fewer words is one
shingle). A window has as many shingles as the item it is held against, or all of a shorter document. It is a leak
if the weighted Jaccard similarity of its shingles and the item's, each weighted by how often it occurs, reaches
``threshold``.

1. Marks are the places where a document has a shingle of any item; which one is not asked. A window similar to an item of
   ``m`` shingles holds at least ``threshold * m`` marks, and moving its start to its first mark loses none, so for each
   size ``m`` that items have, windows that start at a mark and hold so many are all that can be leaks. Of those,
   the ones where marks begin are fingerprinted, and further on one in each ``m / STEPS`` places; a window between
   them differs from the one before by less than that at each end.
2. Each such window and each item get a 64-bit SimHash. Two fingerprints within ``RADIUS`` differ in at most
   ``RADIUS // BLOCKS`` bits in one of ``BLOCKS`` blocks; items are indexed under all block values within that
   distance, and windows look items of their size up by (block, value). All fingerprints within the radius are found, and
   tell which documents may hold which items.
3. Exact similarity decides: of a candidate document and item, all windows that start at a shingle of the item and hold
   enough of them.

At similarity 0.8 a fingerprint bit differs with probability 0.15, so 64 bits differ in 9.7 on average and beyond
the radius with a probability of 9e-6; 1 / STEPS further on with 1e-4. The item index is broadcast while it has at most
``BROADCAST_ROWS`` rows and joined by a shuffle above that.

Defined results. Null or empty texts, and those without letters and digits, hold and are nothing. Repeated rows of
a document give one result, equal ids with different texts one each; null ids likewise. Repeated items are
reported each. Empty tables give no rows. Extra columns are ignored, ``decontaminate`` keeps the documents' ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch, free_name

SHINGLE, THRESHOLD = 5, 0.8
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
#: Fingerprinted windows of a size lie at most 1 / STEPS of it apart.
STEPS = 12
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle(words_: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words_, at + j) for j in range(size)])


def _positions(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for each shingle of ``words``: the kept columns, p (its place) and h (its hash)."""
    fit = df.where(F.size("words") >= size)
    placed = fit.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("p"))
    return placed.select(*keep, "p", shingle(F.col("words"), F.col("p"), size).alias("h"))


def fingerprint(h: str, count: Column) -> Column:
    """64-bit SimHash as an aggregate over rows with hash ``h``; 32 sums hold two bit counters each."""
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned(F.col(h), j).bitwiseAND(pair)) for j in range(32)]
    out = None
    for j, s in enumerate(sums):
        low = F.shiftleft((s.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > count).cast("long"), j)
        high = F.shiftleft((F.shiftrightunsigned(s, 32) * 2 > count).cast("long"), j + 32)
        both = low.bitwiseOR(high)
        out = both if out is None else out.bitwiseOR(both)
    return out


def block(print_: Column, number: int) -> Column:
    return F.shiftrightunsigned(print_, number * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def items_of(benchmark: DataFrame, scratch: Scratch, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Shingles (item_row, item_id, size, m, h, c), fingerprints by (size, m, block, value), and shingle sizes used."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = scratch.table("items", items.withColumn("item_row", F.monotonically_increasing_id()))
    used = [r.n for r in items.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("n")).distinct().collect()]
    placed = None
    for size in used:
        own = items.where(F.size("words") == size) if size < SHINGLE else items.where(F.size("words") >= size)
        rows = _positions(own, size, "item_row", "item_id").withColumn("size", F.lit(size))
        placed = rows if placed is None else placed.unionByName(rows)
    if placed is None:
        placed = items.select("item_row", "item_id", F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("size")).limit(0)
    counted = placed.groupBy("item_row", "item_id", "size", "h").agg(F.count(F.lit(1)).alias("c"))
    total = placed.groupBy("item_row", "size").agg(F.count(F.lit(1)).cast("int").alias("m"), fingerprint("h", F.count(F.lit(1))).alias("item_print"))
    near = F.array(*[F.lit(v) for v in range(1 << BLOCK_BITS) if bin(v).count("1") <= RADIUS // BLOCKS])
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), block(F.col("item_print"), b).alias("own")) for b in range(BLOCKS)])
    index = total.select("item_row", "size", "m", "item_print", F.explode(blocks).alias("b")).select("item_row", "size", "m", "item_print", "b.block", F.explode(F.transform(near, lambda v: v.bitwiseXOR(F.col("b.own")))).alias("value"))
    return scratch.table("shingles", counted.join(total.select("item_row", "m"), "item_row")), scratch.table("index", index), used


def _sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small, by count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that leaks into it: doc_key, doc_id, item_id, similarity, start_word.

    ``similarity`` is the highest of its windows, ``start_word`` the first window that has it.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    shingles, index, used = items_of(benchmark, scratch, item_col, item_text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", words(F.col("text")).alias("words"))
    if not used:
        return docs.sparkSession.createDataFrame([], "doc_key long, doc_id long, item_id long, similarity double, start_word int")
    need = F.ceil(F.col("m") * F.lit(threshold) - 1e-9).cast("int")
    enough = F.filter(F.col("at"), lambda p, i: F.coalesce(F.get(F.col("at"), i + F.col("need") - 1) < p + F.col("m"), F.lit(False)))

    # 1. Marks of any item, and windows of every size an item has.
    known = _sized(shingles.select("size", "h").distinct())
    marks = _union(_positions(keyed, n, "doc_key").join(known.where(F.col("size") == n), "h", "left_semi").select("doc_key", F.lit(n).alias("size"), "p") for n in used)
    shapes = _sized(shingles.select("size", "m").distinct())
    marked = marks.groupBy("doc_key", "size").agg(F.sort_array(F.collect_set("p")).alias("at")).join(shapes, "size").withColumn("need", need)
    step = F.greatest(F.lit(1), F.floor(F.col("m") / STEPS)).cast("int")
    begins = F.filter(F.col("starts"), lambda p: (p % F.col("step") == 0) | ~F.array_contains(F.col("at"), p - 1))
    some = marked.where(F.size("at") >= F.col("need")).withColumn("starts", enough).withColumn("step", step).where(F.size("starts") > 0)
    starts = scratch.table("starts", some.select("doc_key", "size", "m", begins.alias("starts")).where(F.size("starts") > 0))

    # Only documents with such windows are read on. Texts are shuffled as they are, and once; equal rows become one.
    own_texts = texts.select(F.xxhash64("doc_id", "text").alias("doc_key"), "doc_id", "text")
    held = own_texts.join(starts.select("doc_key").distinct().hint("shuffle_hash"), "doc_key", "left_semi")
    held = scratch.table("held", held.groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")))

    # 2. Their fingerprints, looked up among the items'.
    key = ["doc_key", "size", "m", "start"]
    prints = _cells(held, starts, used).groupBy(*key).agg(fingerprint("h", F.count(F.lit(1))).alias("window_print"))
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), block(F.col("window_print"), b).alias("value")) for b in range(BLOCKS)])
    looked = prints.select("doc_key", "size", "m", "window_print").distinct().select("*", F.explode(blocks).alias("b")).select("doc_key", "size", "m", "window_print", "b.block", "b.value")
    near = looked.join(_sized(index), ["size", "m", "block", "value"]).where(F.bit_count(F.col("window_print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    candidates = scratch.table("candidates", near.select("doc_key", "item_row", "size", "m").distinct())

    # 3. Exact similarity of the candidates, on all windows that start at a shingle of the item.
    own = _sized(shingles.select("item_row", "item_id", "size", "m", "h", "c"))
    few = held.join(candidates.select("doc_key").distinct(), "doc_key", "left_semi").withColumn("words", words(F.col("text")))
    found = _union(_positions(few, n, "doc_key").join(own.where(F.col("size") == n).select("item_row", "size", "m", "h"), "h").select("doc_key", "item_row", "size", "m", "p") for n in used)
    placed = found.join(candidates, ["doc_key", "item_row", "size", "m"], "left_semi").groupBy("doc_key", "item_row", "size", "m").agg(F.sort_array(F.collect_set("p")).alias("at")).withColumn("need", need)
    exact = scratch.table("exact", placed.withColumn("starts", enough).where(F.size("starts") > 0).select("doc_key", "item_row", "size", "m", "starts"))
    key = ["doc_key", "doc_id", "item_row", "m", "n", "start"]
    counted = _cells(held, exact, used, "item_row").groupBy(*key, "h").agg(F.count(F.lit(1)).alias("w"))
    common = counted.join(own.select("item_row", "item_id", "h", "c"), ["item_row", "h"]).groupBy(*key, "item_id").agg(F.sum(F.least("w", "c")).alias("common"))
    verified = common.withColumn("similarity", F.col("common") / (F.col("m") + F.col("n") - F.col("common"))).where(F.col("similarity") >= threshold)
    best = F.max(F.struct(F.round("similarity", 6).alias("similarity"), (-F.col("start")).alias("before")))
    leaked = verified.groupBy("doc_key", "doc_id", "item_row", "item_id").agg(best.alias("best"))
    return leaked.select("doc_key", "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).cast("int").alias("start_word"))


def _union(parts) -> DataFrame:
    whole = None
    for p in parts:
        whole = p if whole is None else whole.unionByName(p)
    return whole


def _cells(held: DataFrame, starts: DataFrame, used: list[int], *keep: str) -> DataFrame:
    """A row for each shingle of each window: doc_key, doc_id, kept columns, size, m, n (the window's shingles), start, h.

    ``starts`` has an array of starts for each document; those that would go beyond its end are moved back and count once.
    """
    rows = held.join(starts, "doc_key").withColumn("words", words(F.col("text")))
    total = F.size("words") - F.col("size") + 1
    clipped = F.array_distinct(F.transform("starts", lambda s: F.greatest(F.lit(0), F.least(s, F.col("total") - F.col("m")))))
    rows = rows.withColumn("total", total).select("doc_key", "doc_id", *keep, "size", "m", F.least("m", "total").alias("n"), "words", F.explode(clipped).alias("start"))
    cells = rows.select("*", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("p"))
    h = F.coalesce(*[F.when(F.col("size") == n, shingle(F.col("words"), F.col("p"), n)) for n in used])
    return cells.select("doc_key", "doc_id", *keep, "size", "m", "n", "start", h.alias("h"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a leak; columns and repeated rows are kept."""
    found = Scratch(docs.sparkSession, "leaks").table("found", leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc_key").distinct())
    key = free_name(docs, "doc_key")
    marked = docs.withColumn(key, F.xxhash64(id_col, text_col))
    return marked.join(found.withColumnRenamed("doc_key", key).hint("shuffle_hash"), key, "left_anti").select(*docs.columns)
