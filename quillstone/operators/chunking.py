"""Chunk builders: fixed windows, and table-aware chunks of labelled lines.

Table-aware chunks are built in stages that depend on their predecessor's output (split, merge, overlap): folds over a section's
arrays (``chunk_fold``), or, where a summariser is asked for each chunk, one pass over its lines, many sections an Arrow batch. Sections are independent.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as T
from quillstone.operators import chunk_fold, ranks
from quillstone.operators.lines import classify, islands


def simple_chunks(sections: DataFrame, id_col: str, text_col: str, *keep: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Windows of ``size`` characters, each ``size - overlap`` after the last, until one reaches the end."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    step, rest = size - overlap, F.greatest(F.length(text_col) - size, F.lit(0))
    starts = F.sequence(F.lit(0), (F.ceil(rest / step) * step).cast("int"), F.lit(step))
    full = sections.where(F.length(text_col) > 0)
    placed = full.select(F.col(id_col).alias("section_id"), *keep, text_col, F.posexplode(starts).alias("chunk_no", "start"))
    return placed.select("section_id", *keep, "chunk_no", "start", F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)).alias("text"))


def line_islands(labelled: DataFrame) -> DataFrame:
    """Labelled lines without footers, with kind (table or narrative) and island."""
    kept = labelled.where("label <> 'footer'").withColumn("kind", F.when(F.col("label") == "table_row", "table").otherwise("narrative"))
    return islands(kept, F.col("section_id"), F.col("line_no"), F.col("kind"))


def nature(rows: Column, narrative: Column) -> tuple[Column, Column]:
    """chunk_type and chunk_nature from the numbers of table rows and narrative lines."""
    kind = F.when((rows >= 10) | (rows > narrative), "table").otherwise("narrative")
    return kind.alias("chunk_type"), F.when(rows > narrative, "table_main").otherwise("narrative_main").alias("chunk_nature")


# The grouped pass. Plain Python on one section's lines; text rules are those of ``functions.text``.


def _number(cell: str) -> str:
    bare = cell.replace("$", "").replace(",", "").strip()
    sign = 1
    if bare.startswith("(") and bare.endswith(")"):
        bare, sign = bare[1:-1].strip(), -1
        if not re.fullmatch(fixed.NEGATIVE_CELL, bare):
            return "None"
    try:
        return str(sign * float(bare))
    except ValueError:
        return "None"


def table_text(line: str) -> str:
    ready = re.sub(fixed.LETTER_NUMBER, r"\1 \2", re.sub(fixed.CLOSE_OPEN, r") \1", line.strip()))
    m = re.match(fixed.TABLE_LINE, ready)
    return " | ".join([m[1].strip(), *(_number(c) for c in m.groups()[1:] if c)]) if m else ready.strip()


def render(lines: list[tuple[str, str]]) -> str:
    shown = [(table_text(x) if label == "table_row" else x).replace("\t", "    ").rstrip() for x, label in lines]
    return re.sub("\n{3,}", "\n\n", "\n".join(shown)).strip()


@dataclass
class Chunk:
    lines: list[tuple[str, str]]
    context: dict
    split: bool = False
    context_lines: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    text: str = ""

    def refresh(self) -> Chunk:
        self.text = render(self.lines)
        return self

    @property
    def rows(self) -> int:
        return sum(label == "table_row" for _, label in self.lines)

    @property
    def table(self) -> bool:
        return self.rows >= 10 or self.rows > sum(label == "narrative" for _, label in self.lines)


def line_cost(line: str) -> int:
    return max(len(line.strip()), 1) + 1


def split_bounds(sizes: list[int], most: int, near: int = fixed.SPLIT_OVERLAP_CHARS) -> list[tuple[int, int, int, int]]:
    """(first, end, core first, core end) of each piece: a greedy core of at most ``most``, widened on both sides by
    as many lines as fit into ``near``, then narrowed from the back, the front and the core until it fits."""
    out, start = [], 0
    while start < len(sizes):
        end, used = start, 0
        while end < len(sizes) and used + sizes[end] <= most:
            used, end = used + sizes[end], end + 1
        end = max(end, start + 1)
        first, left = start, near
        while first > 0 and sizes[first - 1] <= left:
            first, left = first - 1, left - sizes[first - 1]
        last, left = end, near
        while last < len(sizes) and sizes[last] <= left:
            last, left = last + 1, left - sizes[last]
        total = sum(sizes[first:last])
        while total > most and last > end:
            last, total = last - 1, total - sizes[last - 1]
        while total > most and first < start:
            first, total = first + 1, total - sizes[first]
        while total > most and last > first + 1:
            last, total = last - 1, total - sizes[last - 1]
        out.append((first, last, start, end))
        start = end
    return out


def split_oversized(chunks: list[Chunk], most: int) -> list[Chunk]:
    if most <= 0:
        return chunks
    out = []
    for c in chunks:
        if len(c.text) <= most:
            out.append(c)
            continue
        for first, last, _, _ in split_bounds([line_cost(x) for x, _ in c.lines], most):
            out.append(Chunk(c.lines[first:last], c.context, True, list(c.context_lines), list(c.titles)).refresh())
    return out


def merge_small(chunks: list[Chunk], small: int = fixed.SMALL_CHUNK_CHARS) -> list[Chunk]:
    out: list[Chunk] = []
    for c in chunks:
        if out and len(c.text) <= small and not c.split and not out[-1].split:
            last = out[-1]
            last.lines, last.context_lines = last.lines + c.lines, (last.context_lines + c.context_lines)[-5:]
            last.titles = last.titles + c.titles
            last.refresh()
        else:
            out.append(c)
    return out


def add_overlap(chunks: list[Chunk], overlap: int) -> None:
    if overlap <= 0:
        return
    for before, c in zip(chunks, chunks[1:]):
        tail = before.text[-overlap:].strip()
        if tail and not c.split and not c.text.startswith(tail):
            c.lines = [(tail, "table_row" if before.table else "narrative"), *c.lines]
            c.refresh()


def summary_prompt(c: Chunk, lines: int = 5, chars: int = 500) -> str:
    """What a summariser is told of a chunk: page, titles, context, and its first lines while they fit. May be empty."""
    first, total = [], 0
    for x, _ in c.lines[:lines]:
        if total + len(x) > chars:
            break
        first, total = [*first, x], total + len(x)
    parts = (("Page", c.context["page_context"]), ("Titles", " | ".join(c.titles)), ("Context", " | ".join(c.context_lines)), ("Start", " ".join(first).strip()))
    return "\n".join(f"{name}: {said}" for name, said in parts if said)


def summary_of(c: Chunk, summarise: Callable[[str], str] | None = None, words: int = 30) -> str:
    """The summariser's answer, else the page context, the first title, the first context line or ``No summary``; at
    most 30 words. Without anything to tell, the summariser is not asked."""
    prompt = summary_prompt(c) if summarise else ""
    made = summarise(prompt).strip().strip('"') if prompt else ""
    first = lambda x: x[0] if x else ""
    return " ".join((made or c.context["page_context"] or first(c.titles) or first(c.context_lines) or "No summary").split()[:words])


CHUNK_SCHEMA = (
    "section_id long, year int, chunk_no int, text string, summary string, chunk_source string, chunk_type string, chunk_nature string, table_row_count int, "
    "page_number int, page_context string, page_section string, page_subsection string, page_subsubsection string, context_lines array<string>"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
CHUNK_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split(" ") for f in CHUNK_SCHEMA.split(", "))])


def table_aware_chunks(sections: DataFrame, id_col: str, text_col: str, year_col: str, *, size: int = 1000, overlap: int = 100, labeller=None, summarise: Callable[[str], str] | None = None) -> DataFrame:
    """Chunks that end where table lines and prose meet; large ones are split, small ones merged, then overlapped.

    They are made by column functions (``chunk_fold``); only with a summariser, which is asked for each chunk, by a pass in Python.
    """
    options = {"labeller": labeller} if labeller else {}
    labelled = classify(sections, id_col, text_col, year_col, **options)
    rows = line_islands(labelled).select("section_id", F.col(year_col).alias("year"), "line_no", "line", "label", "island", "is_title", "page_number", "page_section", "page_subsection", "page_subsubsection")
    if summarise is None:
        return chunk_fold.fold_chunks(rows, size, overlap)

    def of_island(rows: list[tuple]) -> Chunk:
        lines = [(r[3], r[4]) for r in rows]
        said = [x for x, label in lines if label == "narrative"]
        _, _, _, _, _, _, _, page, *names = rows[0]
        context = {"page_number": page, "page_context": " - ".join(n for n in names if n), "names": names}
        return Chunk(lines, context, context_lines=said[-5:] if lines[0][1] == "table_row" else said[:5], titles=[r[3] for r in rows if r[6]]).refresh()

    def of_section(rows: list[tuple]) -> list[tuple]:
        made = [of_island(list(part)) for _, part in groupby(rows, key=lambda r: r[5])]
        chunks = merge_small(split_oversized([c for c in made if c.text], size))
        add_overlap(chunks, overlap)
        out = []
        for n, c in enumerate(chunks):
            main = "table_main" if c.rows > sum(label == "narrative" for _, label in c.lines) else "narrative_main"
            out.append((rows[0][0], rows[0][1], n, c.text, summary_of(c, summarise), "detector_simple", "table" if c.table else "narrative", main, c.rows, c.context["page_number"], c.context["page_context"], *c.context["names"], c.context_lines))
        return out

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines in order of section; one section is held at a time."""
        def pack(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out), CHUNK_ARROW)], schema=CHUNK_ARROW)

        held: list[tuple] = []
        for batch in batches:
            out = []
            for section, part in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[0]):
                if held and held[0][0] != section:
                    out += of_section(held)
                    held = []
                held += part
            if out:
                yield pack(out)
        if held and (out := of_section(held)):
            yield pack(out)

    # One shuffle, by section, that the labels' windows have made already.
    return rows.sortWithinPartitions("section_id", "line_no").mapInArrow(build, CHUNK_SCHEMA)


def chunk_builder(kind: str) -> Callable[..., DataFrame]:
    """The builder of that name: ``simple`` or ``table-aware``."""
    try:
        return {"simple": simple_chunks, "table-aware": table_aware_chunks}[kind]
    except KeyError:
        raise ValueError(f"Unknown chunk builder type: {kind}") from None


# Statistics of chunks.


def totals(chunks: DataFrame) -> DataFrame:
    """total_chunks, table_chunks (with table rows), without_table_chunks; zeros for no chunks."""
    out = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.coalesce("table_row_count", F.lit(0)) > 0).alias("table_chunks"))
    return out.withColumn("without_table_chunks", F.col("total_chunks") - F.col("table_chunks"))


def sizes(chunks: DataFrame, *keep: str) -> DataFrame:
    ends = F.regexp_replace(F.col("text"), r"\r\n|[\n\r\x0B\x0C\x85\u2028\u2029]", "\n")
    lines = F.when(ends == "", 0).otherwise(F.size(F.split(F.regexp_replace(ends, "\n$", ""), "\n", -1)))
    return chunks.select(*keep, F.length("text").alias("char_size"), lines.alias("line_size"))


def stats(sized: DataFrame, column: str, *by: str) -> DataFrame:
    """min, max, mean, median, population stdev and exact percentiles, rounded to two places."""
    shares = {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    out = sized.groupBy(*by).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 2).alias("mean"), F.round(F.stddev_pop(column), 2).alias("stdev"))
    found = ranks.quantiles(sized, column, list(by), shares).select(*[F.col(b).alias(f"of_{b}") for b in by], *[F.round(n, 2).alias(n) for n in shares])
    joined = out.join(found, [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by], "left") if by else out.join(found, F.lit(True), "left")
    return joined.select(*by, "min", "max", "mean", *shares, "stdev")


def histogram(sized: DataFrame, column: str) -> DataFrame:
    """Equal-width bins whose number follows from the quartile distance and the count; the last bin is closed."""
    q = ranks.quantiles(sized, column, [], {"low": 0.25, "high": 0.75}).select(F.array("low", "high").alias("q"))
    base = sized.agg(F.count(F.lit(1)).alias("n"), F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).join(q, F.lit(True), "left")
    span = F.col("hi") - F.col("lo")
    sturges = span / (F.log2(F.col("n")) + 1)
    width = F.when(F.get("q", F.lit(1)) > F.get("q", F.lit(0)), F.least(F.greatest(2 * (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / F.pow(F.col("n"), F.lit(1 / 3)), span / (2 * F.sqrt("n"))), sturges)).otherwise(sturges)
    base = base.withColumn("flat", span == 0).withColumn("bins", F.when(span == 0, 1).otherwise(F.ceil(span / F.greatest(width, F.lit(1.0))).cast("int")))
    base = base.withColumn("lo", F.when(F.col("flat"), F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("flat"), F.col("hi") + 0.5).otherwise(F.col("hi")))
    edge = lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    counted = sized.join(F.broadcast(base)).select(place.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    bins = base.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    label = F.concat(F.bround(edge(F.col("bin"))).cast("long").cast("string"), F.lit("-"), F.bround(edge(F.col("bin") + 1)).cast("long").cast("string"))
    return bins.join(counted, "bin", "left").select("bin", label.alias("label"), F.coalesce("c", F.lit(0)).alias("count"))


def summary(chunks: DataFrame) -> DataFrame:
    """One row: totals, and statistics and histogram of the characters of all chunks."""
    sized = sizes(chunks)
    bins = histogram(sized, "char_size").agg(F.sort_array(F.collect_list(F.struct("bin", "label", "count"))).alias("histogram"))
    whole = stats(sized, "char_size")
    return totals(chunks).join(whole.select(F.struct(*whole.columns).alias("char_stats"))).join(bins)


def review_header(rows: DataFrame, max_filings: int, bins: int = 20) -> DataFrame:
    """One row: number of filings asked for, of chunks, and a histogram of ``char_count`` in ``bins`` equal bins."""
    ends = rows.agg(F.count(F.lit(1)).alias("chunk_count"), F.min("char_count").alias("lo"), F.max("char_count").alias("hi"))
    place = F.coalesce(F.least(F.floor(F.try_divide((F.col("char_count") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)), F.lit(0)).cast("int")
    counted = rows.join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    listed = counted.agg(F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("histogram"))
    return ends.select(F.lit(max_filings).alias("max_filings"), "chunk_count", "lo", "hi").join(listed)
