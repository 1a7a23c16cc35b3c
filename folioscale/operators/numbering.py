"""Numbers along an order, within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from folioscale.session import stored


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each group (no columns: all rows are
    one) by the order.

    A window would bring a whole group into one task. Here the rows are stored
    in ranges of (group, order); a hot group takes many of them. Counts per
    range, a few rows each, tell how many rows of the group come before it.
    Rows that are equal in all these columns get their numbers in any order.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "numbering")
    keys = [*group, *order, "_row"]
    ranges = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = stored(ranges.withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    counts = ranges.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")
    shifts = stored(counts.select(*group, "_range", shift.alias("_shift")), "shifts")
    left, right = ranges.alias("left"), shifts.alias("right")
    same = [F.col(f"left.{key}").eqNullSafe(F.col(f"right.{key}")) for key in (*group, "_range")]
    joined = left.join(right, reduce(lambda a, b: a & b, same))
    kept = [F.col(f"left.{column}") for column in ranges.columns if column not in ("_at", "_range")]
    return joined.select(*kept, (F.col("left._at") + F.col("right._shift")).alias(name))
