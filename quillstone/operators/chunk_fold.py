"""Table-aware chunks by column functions alone: splitting, merging and overlap as folds over a section's arrays.

Everything runs in the JVM after the one shuffle by section that the labels' windows make. What depends on its predecessor is an
``aggregate`` with a small state: where a piece starts (the cost so far), and the text that the next chunk overlaps. What looks at
neighbours only (merging) is a running sum. The rules are those of ``chunking``, whose plain version the tests hold this one against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as T


def _count(values: Column, low_enough) -> Column:
    return F.size(F.filter(values, low_enough))


def piece_starts(ends: Column, costs: Column, most: int) -> Column:
    """First lines of the greedy pieces of at most ``most``, by the running sums of the costs."""
    begin = F.struct(F.lit(0).cast("long").alias("base"), F.array().cast("array<int>").alias("starts"))
    line = F.transform(ends, lambda e, i: F.struct(e.alias("end"), (e - F.get(costs, i)).alias("begin"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(x["begin"].alias("base"), F.concat(acc["starts"], F.array(x["i"])).alias("starts"))
        return F.when((x["i"] == 0) | (x["end"] - acc["base"] > most), new).otherwise(acc)

    return F.aggregate(line, begin, step)["starts"]


def piece_bounds(starts: Column, begins: Column, ends: Column, most: int, near: int = fixed.SPLIT_OVERLAP_CHARS) -> Column:
    """(first, last) of each piece, ``last`` exclusive: its core widened by what fits into ``near`` and narrowed until it fits into ``most``.

    ``begins`` and ``ends`` are the running sums before and after each line, so a count of those within a limit is a place.
    """
    total = F.size(ends)

    def bounds(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), total)
        first = _count(begins, lambda b: b < F.get(begins, start) - near)
        last = _count(ends, lambda e: e <= F.get(ends, end - 1) + near)

        def narrowed(wide: Column) -> Column:
            back = F.least(wide["last"], F.greatest(wide["end"], _count(ends, lambda e: e <= F.get(begins, wide["first"]) + most)))

            def front(x: Column) -> Column:
                first_ = F.least(start, F.greatest(wide["first"], _count(begins, lambda b: b < F.get(ends, x - 1) - most)))
                return T.let(first_, lambda f: F.struct(f.alias("first"), F.greatest(f + 1, F.least(x, _count(ends, lambda e: e <= F.get(begins, f) + most))).alias("last")))

            return T.let(back, front)

        return T.let(F.struct(first.alias("first"), last.alias("last"), end.alias("end")), narrowed)

    return F.transform(starts, bounds)


def shown_line(line: Column, label: Column) -> Column:
    return T.rstrip(F.replace(F.when(label == "table_row", T.parse_financial_table(line)).otherwise(line), F.lit("\t"), F.lit("    ")))


def rendered(raw: Column) -> Column:
    """Text of shown lines that are joined: runs of blank lines made one, ends stripped."""
    return T.strip(F.regexp_replace(raw, "\n{3,}", "\n\n"))


def pieces(placed: DataFrame, size: int) -> DataFrame:
    """Islands of labelled lines, those above ``size`` characters cut: a row for each piece."""
    order = Window.partitionBy("section_id", "island").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cost = (F.greatest(F.length(T.strip(F.col("line"))), F.lit(1)) + 1).cast("long")
    lines = placed.withColumn("cost", cost).withColumn("end", F.sum("cost").over(order)).withColumn("shown", shown_line(F.col("line"), F.col("label")))
    context = ("page_number", "page_section", "page_subsection", "page_subsubsection")
    fields = F.struct("line_no", "line", "label", "shown", "cost", "end", "is_title", *context)
    islands = lines.groupBy("section_id", "year", "island").agg(F.sort_array(F.collect_list(fields)).alias("l"))
    said = F.transform(F.filter("l", lambda x: x["label"] == "narrative"), lambda x: x["line"])
    last5 = lambda a: F.slice(a, F.greatest(F.size(a) - 4, F.lit(1)), F.lit(5))
    first = F.get("l", F.lit(0))
    whole = islands.select(
        "section_id", "year", "island", "l", rendered(F.array_join("l.shown", "\n")).alias("whole"), F.when(first["label"] == "table_row", last5(said)).otherwise(F.slice(said, 1, 5)).alias("context_lines"),
        F.get(F.filter("l", lambda x: x["is_title"]), F.lit(0))["line"].alias("title"), *[first[c].alias(c) for c in context],
    ).where("whole <> ''")
    whole = whole.withColumn("split", F.lit(size > 0) & (F.length("whole") > size)).drop("whole")
    cut = F.when(F.col("split"), piece_starts(F.col("l.end"), F.col("l.cost"), size)).otherwise(F.array(F.lit(0)))
    started = whole.withColumn("starts", cut).withColumn("begins", F.transform("l", lambda x: x["end"] - x["cost"])).withColumn("ends", F.col("l.end"))
    uncut = F.array(F.struct(F.lit(0).alias("first"), F.size("l").alias("last")))
    bounds = F.when(F.col("split"), piece_bounds(F.col("starts"), F.col("begins"), F.col("ends"), size)).otherwise(uncut)
    # An inner explode would make a filter of the expression and evaluate it twice.
    placed = started.withColumn("bounds", bounds).select("*", F.posexplode_outer("bounds").alias("piece", "b")).withColumn("part", F.slice("l", F.col("b.first") + 1, F.col("b.last") - F.col("b.first")))
    count = lambda label: F.size(F.filter("part", lambda x: x["label"] == label)).alias(f"{label}s")
    return placed.select("section_id", "year", "island", "piece", "split", F.array_join("part.shown", "\n").alias("raw"), count("table_row"), count("narrative"), "title", "context_lines", *context)


def merged(parts: DataFrame, small: int = fixed.SMALL_CHUNK_CHARS) -> DataFrame:
    """Pieces of at most ``small`` characters joined to the one before, unless one of both comes from a split."""
    order = Window.partitionBy("section_id").orderBy("island", "piece")
    text = parts.withColumn("joins", (F.length(rendered(F.col("raw"))) <= small) & ~F.col("split") & ~F.lag("split", 1, True).over(order))
    grouped = text.withColumn("chunk", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    context = ("page_number", "page_section", "page_subsection", "page_subsubsection")
    rows = F.struct("island", "piece", "raw", "table_rows", "narratives", "split", "title", "context_lines", *context)
    found = grouped.groupBy("section_id", "year", "chunk").agg(F.sort_array(F.collect_list(rows)).alias("m"), F.sum("table_rows").alias("table_rows"), F.sum("narratives").alias("narratives"))
    every = F.flatten("m.context_lines")
    return found.select(
        "section_id", "year", "chunk", F.array_join("m.raw", "\n").alias("raw"), "table_rows", "narratives", F.get("m.split", F.lit(0)).alias("split"),
        F.get(F.filter("m.title", lambda t: t.isNotNull()), F.lit(0)).alias("title"), F.slice(every, F.greatest(F.size(every) - 4, F.lit(1)), F.lit(5)).alias("context_lines"),
        *[F.get(f"m.{c}", F.lit(0)).alias(c) for c in context],
    )


def is_table(rows: Column, narrative: Column) -> Column:
    return (rows >= 10) | (rows > narrative)


def overlapped(chunks: DataFrame, overlap: int) -> DataFrame:
    """Each chunk begins with the end of the one before as that stands by then; not those from a split, nor where it does so anyway."""
    sections = chunks.groupBy("section_id", "year").agg(F.sort_array(F.collect_list(F.struct("chunk", "raw", "table_rows", "narratives", "split", "title", "context_lines", "page_number", "page_section", "page_subsection", "page_subsubsection"))).alias("g"))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("table"), F.expr("CAST(array() AS array<struct<text:string,table_rows:long,narratives:long>>)").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        tail = T.strip(F.right(acc["text"], F.lit(overlap)))

        def widened(t: Column) -> Column:
            plain = rendered(c["raw"])
            on = (t != "") & ~c["split"] & ~plain.startswith(t) if overlap > 0 else F.lit(False)
            shown = shown_line(t, F.when(acc["table"], "table_row").otherwise("narrative"))
            text = F.when(on, rendered(F.concat(shown, F.lit("\n"), c["raw"]))).otherwise(plain)
            rows = c["table_rows"] + F.when(on & acc["table"], 1).otherwise(0)
            said = c["narratives"] + F.when(on & ~acc["table"], 1).otherwise(0)
            return F.struct(text.alias("text"), rows.cast("long").alias("table_rows"), said.cast("long").alias("narratives"))

        def kept(x: Column) -> Column:
            return F.struct(x["text"].alias("text"), is_table(x["table_rows"], x["narratives"]).alias("table"), F.concat(acc["out"], F.array(x)).alias("out"))

        return T.let(T.let(tail, widened), kept)

    folded = sections.withColumn("out", F.aggregate("g", start, step)["out"])
    placed = folded.select("section_id", "year", F.posexplode_outer(F.arrays_zip("out", "g")).alias("chunk_no", "c"))
    return placed.select("section_id", "year", "chunk_no", "c.out.text", "c.out.table_rows", "c.out.narratives", *[F.col(f"c.g.{n}").alias(n) for n in ("title", "context_lines", "page_number", "page_section", "page_subsection", "page_subsubsection")])


def fold_chunks(placed: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of the lines that ``chunking.line_islands`` placed, which also have year, is_title and the page context."""
    out = overlapped(merged(pieces(placed, size)), overlap)
    names = ("page_section", "page_subsection", "page_subsubsection")
    told = F.concat_ws(" - ", *[F.nullif(F.col(c), F.lit("")) for c in names])
    first = F.coalesce(F.nullif(told, F.lit("")), F.nullif("title", F.lit("")), F.nullif(F.get("context_lines", F.lit(0)), F.lit("")), F.lit("No summary"))
    rows, said = F.col("table_rows"), F.col("narratives")
    return out.select(
        "section_id", "year", "chunk_no", "text", T.truncate_words(first, 30).alias("summary"), F.lit("detector_simple").alias("chunk_source"), F.when(is_table(rows, said), "table").otherwise("narrative").alias("chunk_type"),
        F.when(rows > said, "table_main").otherwise("narrative_main").alias("chunk_nature"), rows.cast("int").alias("table_row_count"), "page_number", told.alias("page_context"), *names, "context_lines",
    )
