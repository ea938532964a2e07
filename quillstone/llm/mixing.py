"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Sizes are words. Each source has a weight and a weight schedule over training time ``t`` in [0, 1]. Targets share
all words by weight; a source stops at ``cap`` times its size and its excess is shared again by weight (water
filling). A source's documents stand in the order of a hash of their ids; its demand runs through that order
``target / size`` times, so every document is read ``floor(target / size)`` times and the documents at the front of
the order once more, the last of them in part, which makes taken words equal the rounded target. The schedule is
integrated to a cumulative share of the demand, and its inverse turns a document's place in the demand into its
training position. ``schedule`` range-sorts the copies by position.

Running sums over a source are taken in two levels, by hash range within the source, so a source that holds a
third of all rows is spread over as many groups as its row count asks for.

Defined results. Null text has size 0 and is taken 0 times. A null source is a source of its own, last in order.
A null id hashes like the empty text. Rows with equal ids are ordered by size; equal rows are interchangeable.
Sources without words have target 0. An empty table gives no rows. Extra columns are ignored by ``mix``; only
``schedule`` carries them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch, free_name

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
#: One schedule for each weight, repeating like the weights: (t, relative weight) knots, linear in between. Heavy
#: sources fade, light ones rise towards the end of training.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a hash range of a source, about.
RANGE_ROWS = 2048
#: A source table up to this many rows is broadcast; above, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), order.alias("order"), *more)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_no, source_size, n_docs, target. Sources are few beside documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by = by.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    filling = Window.orderBy("ratio", "source_no")
    everything = Window.partitionBy()
    by = by.withColumn("ratio", F.col("most") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything))
    by = by.withColumn("full", F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)
    by = by.withColumn("water", F.coalesce(first["level"], F.lit(float("inf"))))
    return by.select("source", "source_no", "source_size", "n_docs", F.least("most", F.col("water") * F.col("weight")).alias("target"))


def position(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a schedule's integral reaches ``share`` of its total; piecewise quadratic, inverted."""
    chosen = None
    for k, knots in enumerate(schedules):
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        whole, done, branch = sum(areas), 0.0, None
        for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
            slope, rest = (w1 - w0) / (t1 - t0), F.greatest(share * whole - done, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            at = F.least(F.lit(t0) + F.coalesce(F.try_divide(2 * rest, F.lit(w0) + root), F.lit(0.0)), F.lit(t1))
            inside = share * whole <= done + area
            branch = F.when(inside, at) if branch is None else branch.when(inside, at)
            done += area
        branch = branch.otherwise(F.lit(knots[-1][0]))
        chosen = F.when(kind == k, branch) if chosen is None else chosen.when(kind == k, branch)
    return chosen


def demand(sized: DataFrame, by_source: DataFrame) -> DataFrame:
    """Each document's place in its source's demand: adds source_size, target, source_no, before, passes, extra, taken."""
    small = by_source.count() <= BROADCAST_SOURCES
    by_source = F.broadcast(by_source) if small else by_source
    rows = sized.alias("d").join(by_source.alias("s"), F.expr("d.source <=> s.source")).select("d.*", "s.source_size", "s.n_docs", "s.source_no", "s.target")
    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * ranges, 32))
    sums = rows.groupBy("source_no", "range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source_no").orderBy("range")) - F.col("range_size")
    rows = rows.join(sums.select("source_no", "range", before.alias("range_before")), ["source_no", "range"])
    inside = Window.partitionBy("source_no", "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("before", F.col("range_before") + F.sum("size").over(inside) - F.col("size"))
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    rows = rows.withColumn("passes", passes).withColumn("left", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    rows = rows.withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("left") - F.col("before"))))
    return rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra")).drop("range", "range_before", "left", "n_docs")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_position; range-sorted by position."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.table("sizes", sizes(docs, id_col, source_col, text_col))
    by_source = scratch.table("sources", targets(sized, weights, cap))
    rows = demand(sized, by_source)
    share = F.least(F.lit(1.0), (F.col("before") + F.col("size") / 2) / F.col("target"))
    first = F.when(F.col("taken") > 0, F.round(position(share, F.col("source_no") % len(schedules), schedules), 6))
    rows = rows.withColumn("first_position", first)
    # The hash order spreads the documents that share a position, above all those that are not taken.
    rows = rows.orderBy(F.col("first_position").asc_nulls_last(), "order", "doc_id")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_position")


def schedule(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS, cap: float = CAP, schedules=SCHEDULES) -> DataFrame:
    """The mixed corpus: all columns of ``docs`` plus ``position``, a row per copy, range-sorted by position.

    Copies are whole documents; the partly taken last one is kept if at least half of it is taken. Documents
    without words have no share in the demand and leave the mix.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.xxhash64(*[F.col(c) for c in (id_col, source_col, text_col)])
    sized = scratch.table("sizes", sizes(docs, id_col, source_col, text_col, key.alias("key")))
    rows = demand(sized, scratch.table("sources", targets(sized, weights, cap)))
    copies = F.col("passes") + (F.col("extra") * 2 >= F.col("size")).cast("long")
    rows = rows.withColumn("copies", copies).where("size > 0 AND copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    share = F.least(F.lit(1.0), (F.col("copy") * F.col("source_size") + F.col("before") + F.col("size") / 2) / F.col("target"))
    rows = rows.select("key", "before", position(share, F.col("source_no") % len(schedules), schedules).alias("position"))
    lists = rows.groupBy("key", "before").agg(F.collect_list("position").alias("positions")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("before", "positions"))).alias("lists"))
    lists = scratch.table("positions", lists)
    # Equal rows share a key; each of them takes the positions of another place in the demand.
    own, nth, places = (free_name(docs, n) for n in ("key", "nth", "lists"))
    marked = docs.withColumn(own, key).withColumn(nth, F.row_number().over(Window.partitionBy(own).orderBy(F.lit(1))))
    joined = marked.join(lists.select(F.col("key").alias(own), F.col("lists").alias(places)).hint("shuffle_hash"), own)
    position_col = position_name(docs)
    taken = joined.select(*docs.columns, F.explode(F.try_element_at(places, F.col(nth))["positions"]).alias(position_col))
    return taken.orderBy(position_col)


def position_name(docs: DataFrame) -> str:
    """The column that ``schedule`` adds to ``docs``: ``position``, with underscores before it where that is taken."""
    return free_name(docs, "position")
