"""Row numbers and exact quantiles of groups that may hold most of the table: ranges of the order are numbered apart.

Bounds of ``RANGES`` ranges come from approximate percentiles of the whole column: a few numbers on the driver, of which only the balance
depends. A row's range follows from its own value, so every evaluation deals alike. Counts of ranges, pre-aggregated, give each
range its offset; a task then orders one range of one group. Rows of equal order value stay together, so the order should be (nearly) unique;
quantiles count equal values first and need no such thing.

Defined results: null order values come first, as in Spark's own order; quantiles leave nulls out and are null for groups without values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group at most.
RANGES = 256


def ranges(df: DataFrame, column: str, n: int = RANGES) -> Column:
    """The range, from 0 up, of a row's ``column`` among ``n`` of about equal size over the whole table."""
    cuts = df.agg(F.percentile_approx(column, [k / n for k in range(1, n)])).first()[0] or []
    bounds = sorted({float(c) for c in cuts})
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(column))) if bounds else F.lit(0)


def _before(rows: DataFrame, by: list[str], range_: str, amount: Column) -> DataFrame:
    """by, range and ``offset``: the sum of ``amount`` over the group's smaller ranges; a row for each group and range."""
    sums = rows.groupBy(*by, range_).agg(F.sum(amount).alias("amount"))
    order = Window.partitionBy(*by).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*[F.col(b).alias(f"own_{b}") for b in by], F.col(range_).alias("own_range"), F.coalesce(F.sum("amount").over(order), F.lit(0)).alias("offset"))


def _with_offsets(rows: DataFrame, by: list[str], range_: str, amount: Column) -> DataFrame:
    offsets = _before(rows, by, range_, amount)
    same = [F.col(b).eqNullSafe(F.col(f"own_{b}")) for b in by] + [F.col(range_) == F.col("own_range")]
    return rows.join(offsets, same).drop(*[f"own_{b}" for b in by], "own_range")


def numbered(df: DataFrame, by: list[str], order: str, out: str, *ties: str, n: int = RANGES) -> DataFrame:
    """Adds ``out``: the row's number from 1 within ``by``, by ``order`` (a number), then ``ties``."""
    rows = df.withColumn("range", F.when(F.col(order).isNull(), -1).otherwise(ranges(df, order, n)))
    within = F.row_number().over(Window.partitionBy(*by, "range").orderBy(order, *ties))
    return _with_offsets(rows, by, "range", F.lit(1)).withColumn(out, (within + F.col("offset")).cast("int")).drop("range", "offset")


def quantiles(df: DataFrame, column: str, by: list[str], shares: dict[str, float], n: int = RANGES) -> DataFrame:
    """by and a column for each share: the exact quantile, between the two nearest values in proportion."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("rows"))
    placed = _with_offsets(counted.withColumn("range", ranges(df, column, n)), by, "range", F.col("rows"))
    running = Window.partitionBy(*by, "range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.withColumn("upto", F.sum("rows").over(running) + F.col("offset"))
    sizes = counted.groupBy(*by).agg(F.sum("rows").alias("size")).select(*[F.col(b).alias(f"own_{b}") for b in by], "size")
    joined = upto.join(sizes, [F.col(b).eqNullSafe(F.col(f"own_{b}")) for b in by]) if by else upto.join(sizes)
    place = lambda p: F.lit(p) * (F.col("size") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(column)))
    found = joined.groupBy(*by).agg(F.first("size").alias("size"), *[at(F.floor(place(p))).alias(f"{k}_low") for k, p in shares.items()], *[at(F.ceil(place(p))).alias(f"{k}_high") for k, p in shares.items()])
    part = lambda k, p: (F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * (place(p) - F.floor(place(p)))).alias(k)
    return found.select(*by, *[part(k, p) for k, p in shares.items()])
