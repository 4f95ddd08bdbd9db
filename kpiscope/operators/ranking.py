"""Ranks and totals of groups of any size, without a window over a group.

A window partitioned by the group sorts all its rows in one task, so a dimension of a hundred
million slices is one task's work. Here the rows are range-partitioned by (group, order) and sorted
within their partitions; a row's number within its partition follows from that order alone. One small
aggregate then tells how many rows of a group every partition holds. Their running sum over the
partitions is the offset that turns a number within a partition into a rank, and the same small table
carries whole-group totals. Only that table, with a row for each (group, partition) that meet, sees a
window.

The sorted rows are written once: partition numbers must be the same for the counts and for the rows
that they number, whatever executors are lost between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.session import materialize

# Largest table of (group, partition) rows that is broadcast back to the rows, in rows of under 100 bytes.
BROADCAST_HEADS = 200_000

_ID, _PART = "_row_id", "_part"


def sorted_rows(df: DataFrame, group: list[str], order: list[Column], name: str = "ranked") -> DataFrame:
    """``df`` range-partitioned and sorted by (group, order), written once, with the rows' numbers."""
    keys = [F.col(g).asc() for g in group] + order
    numbered = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn(_ID, F.monotonically_increasing_id()))
    # the upper bits of that id are the partition's number
    return materialize(numbered.withColumn(_PART, F.shiftright(_ID, 33)), name)


def with_rank(df: DataFrame, group: list[str], order: list[Column], rank: str,
              totals: dict[str, Column] | None = None, name: str = "ranked") -> DataFrame:
    """``df`` with each row's rank (1 is first) within its group, and whole-group ``totals``.

    ``order`` must decide every tie, as for any reproducible rank; rows equal in it get ranks in any
    order. Totals are sums of the given row-wise columns; NULL where every value of a group is.
    Null group values form a group of their own.
    """
    totals = totals or {}
    rows = sorted_rows(df, group, order, name)
    heads = rows.groupBy(*group, _PART).agg(F.min(_ID).alias("_first"), F.count(F.lit(1)).alias("_n"),
                                            *[F.sum(c).alias(t) for t, c in totals.items()])
    heads = materialize(heads, f"{name}-heads")
    whole = Window.partitionBy(*group)
    before = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*group, _PART, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                         *[F.sum(t).over(whole).alias(t) for t in totals])
    small = heads.count() <= BROADCAST_HEADS
    renamed = heads.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(_PART).alias("_p"),
                           "_first", "_offset", *totals)
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col(_PART) == F.col("_p")]
    joined = rows.join(F.broadcast(renamed) if small else renamed, on)
    return joined.withColumn(rank, F.col("_offset") + F.col(_ID) - F.col("_first") + 1).select(*df.columns, rank, *totals)
