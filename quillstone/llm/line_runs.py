"""Line de-duplication: maximal repeated runs of lines, from the suffix array of line-id sequences.

A document is the sequence of its lines that are not blank. Prefix doubling ranks all suffixes of all sequences by
their first 1, 2, 4, ... lines until no rank is shared: suffixes with equal ranks at length ``h`` are an interval of the
suffix array whose longest common prefix reaches ``h``, named by the place of its first occurrence. A rank of length 2h comes
from the ranks of length h of a suffix and of the suffix h lines on, one grouping a round. A suffix whose rank is its
own is settled and leaves, so rounds shrink to what still repeats; copies settle at the end of their document.

In each interval the first occurrence, by document id and line, stays; the others lose their run. The longest interval of
each suffix counts: a maximal run of m lines is covered by those of its first and its last 2^k lines, so the union
of these runs is that of all maximal repeated runs; runs that overlap or touch are one. ``min_lines`` is the least length
of a run, and doubling goes through it. A line of more than ``long_words`` words is a run by itself, judged by the
ranks of single lines.

A rank is a minimum, so groupings combine on the map side; ranks go back to their lines by a join whose other side
has one row a rank, which adaptive execution splits where a line is very frequent. A window holds the lines of one
document.

Defined results. Null text is the empty text and has one, blank, line. Blank lines (white space only) never match
and always stay. Documents with fewer lines than ``min_lines`` keep all but long lines. Repeated rows: one of them is the first.
Null ids come before all others. Runs are judged on the input, also where they overlap themselves. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.store import Scratch

MIN_LINES = 2
#: Lines of more words than this are repeats by themselves.
LONG_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"^[\x20\x09-\x0D]*$"


def _ranked(rows: DataFrame, scratch: Scratch, name: str, *names: str) -> DataFrame:
    """Rows whose ``names`` occur again, with the first occurrence (first_rid, first_line); order by (doc_id, rid, line).

    Ranks that occur once are left out. Shared ones are looked up from a written table: a plain side lets adaptive
    execution split a very frequent rank.
    """
    first = rows.groupBy(*names).agg(F.min(F.struct("doc_id", "rid", "line")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = scratch.table(f"first-{name}", first.select(*names, F.col("first.rid").alias("first_rid"), F.col("first.line").alias("first_line")))
    kept = [c for c in rows.columns if c not in names]
    return scratch.table(f"ranks-{name}", rows.join(found, list(names)).select(*kept, "first_rid", "first_line"))


def repeated_starts(lines: DataFrame, min_lines: int, scratch: Scratch) -> DataFrame:
    """(rid, line, length): for every suffix the longest doubled length at which it occurred before, and long lines.

    ``lines`` has doc_id, rid, line, long, one, two. Lengths are ``min_lines`` times powers of two.
    """
    again = F.expr("first_rid <> rid OR first_line <> line")
    ranks = _ranked(lines, scratch, "1", "one", "two")
    found = ranks.where("long").where(again).select("rid", "line", F.lit(1).alias("length"))
    ranks, h = ranks.drop("long"), 1
    order = Window.partitionBy("rid").orderBy("line")
    while True:
        if h >= min_lines:
            found = found.unionByName(ranks.where(again).select("rid", "line", F.lit(h).alias("length")))
        # On the way to ``min_lines`` the halves overlap where that is no power of two.
        ahead = min(h, min_lines - h) if h < min_lines else h
        there = order.rangeBetween(ahead, ahead)  # the suffix ``ahead`` lines on, if it shares its rank
        both = ranks.withColumn("next", F.first(F.struct("first_rid", "first_line")).over(there)).where("next IS NOT NULL")
        both = both.select("doc_id", "rid", "line", F.col("first_rid").alias("own_rid"), F.col("first_line").alias("own_line"), F.col("next.first_rid").alias("next_rid"), F.col("next.first_line").alias("next_line"))
        h += ahead
        ranks = _ranked(both, scratch, str(h), "own_rid", "own_line", "next_rid", "next_line")
        if ranks.isEmpty():
            break
    return found.groupBy("rid", "line").agg(F.max("length").alias("length"))


def maximal_runs(starts: DataFrame) -> DataFrame:
    """(rid, first, last) of the union of runs; runs that overlap or touch are one."""
    by = Window.partitionBy("rid")
    reached = F.max(F.col("line") + F.col("length")).over(by.orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    marked = starts.withColumn("begins", F.coalesce(F.col("line") > reached, F.lit(True)).cast("int"))
    numbered = marked.withColumn("run", F.sum("begins").over(by.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("rid", "run").agg(F.min("line").alias("first"), (F.max(F.col("line") + F.col("length")) - 1).alias("last")).drop("run")


def line_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_runs, kept (the text without later copies of runs)."""
    scratch = Scratch(docs.sparkSession, "lines")
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    # Lines are stored as an array: below, lambdas may only touch stored columns, as they evaluate anything else anew
    # for each element.
    texts = scratch.table("texts", docs.select(F.col(id_col).alias("doc_id"), split.alias("lines")).withColumn("rid", F.monotonically_increasing_id()))
    used = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("place"), x.alias("content"))), lambda x: ~x["content"].rlike(BLANK))
    lines = texts.select("doc_id", "rid", F.posexplode(used).alias("line", "x"))
    # So many words need at least one character each and one between them.
    long = (F.length("x.content") > 2 * long_words) & (F.regexp_count("x.content", F.lit(WORD)) > long_words)
    lines = lines.select("doc_id", "rid", "line", "x.place", long.alias("long"), F.xxhash64("x.content").alias("one"), F.xxhash64(F.lit(1), "x.content").alias("two"))
    lines = scratch.table("lines", lines)
    runs = maximal_runs(repeated_starts(lines.drop("place"), min_lines, scratch))
    removed = runs.select("rid", F.explode(F.sequence("first", "last")).alias("line"), F.col("first"))
    removed = removed.join(lines.select("rid", "line", "place"), ["rid", "line"])
    gone = removed.groupBy("rid").agg(F.sort_array(F.collect_list("place")).alias("places"), F.count_if(F.col("line") == F.col("first")).cast("int").alias("n_runs"))
    joined = texts.join(scratch.table("gone", gone).hint("shuffle_hash"), "rid", "left")
    n = F.size("places")

    def between(k):
        """The lines between the k-th removed one and the one before."""
        begin = F.coalesce(F.get("places", k - 1), F.lit(-1)) + 1
        return F.slice("lines", begin + 1, F.coalesce(F.get("places", k), F.size("lines")) - begin)

    left = F.when(n.isNull(), F.col("lines")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), n), between)))
    removed_lines = F.coalesce(n, F.lit(0))
    return joined.select("doc_id", F.size("lines").alias("n_lines"), removed_lines.alias("n_removed"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.array_join(left, "\n").alias("kept"))
