"""Lines of sections: splitting, labels, page context, context windows. One shuffle, by section, serves them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T


def by_section():
    """The lines of a section in order."""
    return Window.partitionBy("section_id").orderBy("line_no")



def split_lines(sections: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """One row per line, blank ones too: section_id, line_no from 0, line, and the kept columns."""
    clean = T.no_break_to_space(F.col(text_col))
    return sections.select(F.col(id_col).alias("section_id"), *keep, F.posexplode(F.split(clean, "\n", -1)).alias("line_no", "line"))


def page_number_lines(lines: DataFrame) -> DataFrame:
    """Adds is_page_number: one to three digits between blank neighbours or ends of the section."""
    return _marked(lines.withColumn("is_blank", T.blank(F.col("line")))).drop("is_blank")


def _marked(lines: DataFrame) -> DataFrame:
    near = lambda f: F.coalesce(f("is_blank").over(by_section()), F.lit(True))
    # Few lines start with a digit; only those are stripped.
    number = F.col("line").rlike(r"^\s*\d") & T.strip(F.col("line")).rlike(r"^\d{1,3}$")
    return lines.withColumn("is_page_number", number & near(F.lag) & near(F.lead))


def rule_labels(lines: DataFrame) -> DataFrame:
    """Adds label of every non-blank line by the rules; blank lines are dropped.

    The rules are tried once for each line, between the shuffle by section and the windows: above the windows, filters and
    projections on the label would each try them anew.
    """
    typed = lines.repartition("section_id").withColumns({"is_blank": T.blank(F.col("line")), "rule": T.rule_type(F.col("line"))})
    marked = _marked(typed).where("NOT is_blank")
    return marked.withColumn("label", T.rule_label(F.col("rule"), F.col("is_page_number"))).drop("is_blank", "rule")


def page_context(labelled: DataFrame) -> DataFrame:
    """Adds the running page context: first page number and form label, last section names, seen in footers so far."""
    meta = F.when(F.col("label") == "footer", T.footer_meta(F.col("line")))
    so_far = by_section().rowsBetween(Window.unboundedPreceding, 0)
    with_meta = labelled.withColumn("meta", meta)
    sections = F.last("meta.sections", ignorenulls=True).over(so_far)
    out = with_meta.withColumn("page_number", F.first("meta.page_number", ignorenulls=True).over(so_far))
    out = out.withColumn("form_label", F.first("meta.form_label", ignorenulls=True).over(so_far)).withColumn("sections", sections)
    names = ("section", "subsection", "subsubsection")
    return out.select("*", *[F.col(f"sections.{n}").alias(f"page_{n}") for n in names]).drop("meta", "sections")


def classify(sections: DataFrame, id_col: str, text_col: str, *keep: str, labeller: Callable[[DataFrame], DataFrame] = rule_labels) -> DataFrame:
    """Labelled non-blank lines with page context and is_title. ``labeller`` adds ``label`` to lines."""
    labelled = labeller(split_lines(sections, id_col, text_col, *keep))
    return page_context(labelled).withColumn("is_title", T.is_title(F.col("line")))


def pseudo_labels(sections: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A label for every line of a section, ``blank`` for blank ones, ``narrative`` where no labeller spoke."""
    ends = sections.select(F.col(id_col).alias("section_id"), F.regexp_replace(text_col, "\r\n?", "\n").alias("text"))
    everything = split_lines(ends, "section_id", "text")
    known = rule_labels(everything).select("section_id", "line_no", "label")
    joined = everything.join(known, ["section_id", "line_no"], "left")
    label = F.when(T.strip(F.col("line")) == "", "blank").otherwise(F.coalesce("label", F.lit("narrative")))
    return joined.select("section_id", "line_no", "line", label.alias("label"))


def context_windows(lines: DataFrame, size: int = 2, targets: tuple[str, ...] | None = None) -> DataFrame:
    """Adds prev_text, current_line, next_text of ``size`` lines on both sides; then keeps the target labels only."""
    own = lines.withColumn("current_line", T.context_line(F.col("line")))
    near = lambda f, k: f("current_line", k, "<BLK>").over(by_section())
    before = F.concat_ws("\n", *[near(F.lag, k) for k in range(size, 0, -1)])
    after = F.concat_ws("\n", *[near(F.lead, k) for k in range(1, size + 1)])
    out = own.withColumn("prev_text", before).withColumn("next_text", after)
    return out.where(F.col("label").isin(*targets)) if targets else out


def islands(rows: DataFrame, by: Column, order: Column, kind: Column) -> DataFrame:
    """Adds island: a number for each run of equal ``kind`` within ``by``."""
    w = Window.partitionBy(by).orderBy(order)
    start = F.when(F.lag(kind).over(w).eqNullSafe(kind), 0).otherwise(1)
    return rows.withColumn("start", start).withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("start")
