"""Exact de-duplication: groups of equal texts by content hash, checked byte by byte; one row of each stays.

1. A scan writes for each row its id, the 128-bit hash of its text, the SHA-256 and a hash of its other columns.
2. Rows are counted by hash, with the row that stays; both are pre-aggregated before the shuffle, so a group of any size is
   a row a task.
3. The texts of hashes with several rows are grouped by hash and text, which compares their bytes. Copies are
   folded in the task that reads them, so a group moves one text a task. Hashes with more than one text are collisions.
4. Each row gets its group's decision. Groups that hold a 256th of all rows or more, at most 256, are broadcast; the others
   are joined by hash. Rows of collided hashes are decided by hash and text together.

Where the hashes with several rows are at most ``BROADCAST_GROUPS`` they are broadcast before step 3; beyond, all
texts are grouped there. The result is the same.

Defined results. A null text counts as empty, and empty texts are equal. Null ids stay only in groups without other
ids. Repeated rows (same id and text) count as rows each; one stays, by the hash of its other columns, then by position. Columns of map
and variant type are not hashed. An empty table gives no rows. Texts of any length are hashed whole. ``deduplicate`` returns the columns it was given, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from quillstone.llm.store import Scratch, free_name

#: Hashes broadcast at most: 16 bytes each, about 50 MB with their table.
BROADCAST_GROUPS = 500_000
#: A group with this part of all rows is joined by broadcast; there are at most as many.
HOT_PART = 256


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def _rows(docs: DataFrame, id_col: str, text_col: str, row_col: str | None, normalise: Callable, digest: Callable) -> DataFrame:
    """doc_id, text as compared, h, tie and rid of every row; rid is ``row_col`` or a number of this scan."""
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col, row_col) and _hashable(f.dataType)]
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    tie = F.xxhash64(*others) if others else F.lit(0).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), tie.alias("tie"), rid.alias("rid")).withColumn("h", digest(F.col("text")))


def _groups(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """Groups of several rows: keys, group_size, and id and rid of the row that stays."""
    known = F.col("doc_id").isNotNull()
    order = F.struct((known if keep == "largest" else ~known).alias("null_last"), "doc_id", "tie", "rid")
    best = F.max(order) if keep == "largest" else F.min(order)
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1")
    return found.select(*keys, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))


def _decide(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Every row with its group's decision; rows without a group stay."""
    is_hot = F.col("group_size") * HOT_PART >= total
    hot, cold = groups.where(is_hot), groups.where(~is_hot)
    marked = rows.join(F.broadcast(hot), keys, "left")
    own = [*rows.columns]
    decided = marked.where("group_size IS NOT NULL").unionByName(marked.where("group_size IS NULL").select(*own).join(cold, keys, "left"))
    alone = F.col("group_size").isNull()
    return decided.select(
        "rid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _find(docs: DataFrame, *, id_col: str, text_col: str, keep: str, normalise: Callable, digest: Callable, row_col: str | None = None) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    scratch = Scratch(docs.sparkSession, "exact")
    rows = _rows(docs, id_col, text_col, row_col, normalise, digest)
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")
    hashed = scratch.table("hashed", rows.select("rid", "doc_id", "tie", "h", sha), "lz4")
    groups = scratch.table("groups", _groups(hashed, ["h"], keep), "lz4")
    texts = rows.select("h", "text")
    if groups.count() <= BROADCAST_GROUPS:
        texts = texts.join(F.broadcast(groups.select("h")), "h", "left_semi")
    different = texts.groupBy("h", "text").agg(F.count(F.lit(1)).alias("rows"))
    collided = scratch.table("collided", different.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "lz4")
    total = hashed.count()
    if collided.isEmpty():
        return _decide(hashed, groups, ["h"], total)
    apart = scratch.table("apart", rows.join(collided, "h", "left_semi").select("rid", "doc_id", "tie", "h", sha, "text"), "lz4")
    by_text = scratch.table("groups-by-text", _groups(apart, ["h", "text"], keep), "lz4")
    same = _decide(hashed.join(collided, "h", "left_anti"), groups.join(collided, "h", "left_anti"), ["h"], total)
    return same.unionByName(_decide(apart, by_text, ["h", "text"], total))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lambda c: c, digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (id of the row that stays), group_size, kept, text_sha256.

    ``normalise`` maps the text column to what is compared; ``digest`` gives the hash that groups are made by, whose collisions are found.
    """
    return _find(docs, id_col=id_col, text_col=text_col, keep=keep, normalise=normalise, digest=digest).drop("rid")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lambda c: c, digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    row = free_name(docs, "row_number")
    numbered = Scratch(docs.sparkSession, "exact-rows").table("rows", docs.withColumn(row, F.monotonically_increasing_id()))
    found = _find(numbered, id_col=id_col, text_col=text_col, keep=keep, normalise=normalise, digest=digest, row_col=row)
    gone = found.where(~F.col("kept")).select(F.col("rid").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
