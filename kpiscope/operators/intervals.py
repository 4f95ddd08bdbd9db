"""Dyadic interval join: rows whose day lies in a window, by one equi-join.

A window of days is cut into aligned ranges of 1, 2, 4, ... days, at most two of each length, so a
window of d days has fewer than 2 * log2(d) + 2 of them however long it is. A day lies in exactly one
aligned range of each length, so a fact row carries one key for each length that the windows use, and
(level, bin) is the join key. The ranges of a window are disjoint: a row meets it once at most.

Ranges up to a measured count are broadcast and the fact is not shuffled. Beyond it both sides are
shuffled by (level, bin, salt): a bin of a long range holds many days of rows, so rows are spread over
``salts`` parts of it by a key of theirs and the ranges are repeated for each part. That join sorts
and can spill; a hash table of a bin's windows need not fit in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Most ranges (rows of under 200 bytes) that are broadcast.
BROADCAST_RANGES = 500_000
SALTS = 8
MAX_LEVEL = 22      # a range of 2^22 days holds every date


def _bins(level: int, first: Column, end: Column) -> Column:
    """The ranges of 2^level days, by number, that [first, end) is cut into and no longer range covers."""
    def full(k: int) -> tuple[Column, Column]:
        return F.shiftright(first + F.lit((1 << k) - 1), k), F.shiftright(end, k)

    lo, hi = full(level)
    lo_up, hi_up = full(level + 1)
    longer = lo_up < hi_up
    left = F.when((lo < hi) & (~longer | (F.pmod(lo, F.lit(2)) == 1)), lo)
    last = hi - 1
    right = F.when((lo < hi) & F.when(longer, F.pmod(hi, F.lit(2)) == 1).otherwise(last > lo), last)
    return F.array_compact(F.array(left, right))


def dyadic_ranges(windows: DataFrame, lo: str, hi: str) -> DataFrame:
    """The windows' columns with ``level`` and ``bin``, a row for each range.

    Both ends are inclusive. A window that ends before it starts, or with a null end, has no ranges.
    """
    number = windows.where(F.col(lo) <= F.col(hi)).withColumns({
        "_first": F.unix_date(F.col(lo)), "_end": F.unix_date(F.col(hi)) + 1})

    def of_level(k: int) -> Column:
        return F.transform(_bins(k, F.col("_first"), F.col("_end")),
                           lambda b: F.struct(F.lit(k).alias("level"), b.cast("int").alias("bin")))

    ranges = F.flatten(F.array(*[of_level(k) for k in range(MAX_LEVEL + 1)]))
    return (number.select(*windows.columns, F.explode(ranges).alias("_r"))
            .select(*windows.columns, "_r.level", "_r.bin"))


def range_extent(ranges: DataFrame) -> tuple[int, list[int]]:
    """Number of ranges and the levels that occur: one aggregate over the windows."""
    row = ranges.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("level")).alias("levels")).first()
    return int(row["n"]), list(row["levels"])


def interval_join(facts: DataFrame, windows: DataFrame, day: str, lo: str, hi: str, spread: str,
                  limit: int = BROADCAST_RANGES, salts: int = SALTS) -> DataFrame:
    """Every (fact row, window) with lo <= day <= hi: the columns of both, which must not clash.

    ``spread`` is a column of the facts of many values, by which rows of one range are spread where the
    ranges are too many to be broadcast. Rows with a null day meet nothing; repeated rows and windows
    meet each other as often as they occur. The windows are read twice.
    """
    ranges = dyadic_ranges(windows, lo, hi)
    n, levels = range_extent(ranges)
    if not levels:
        return facts.join(windows, F.lit(False))
    number = F.unix_date(F.col(day))
    keys = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(number, k).alias("bin")) for k in levels])
    keyed = (facts.where(F.col(day).isNotNull()).select("*", F.explode(keys).alias("_k"))
             .select(*facts.columns, "_k.level", "_k.bin"))
    if n <= limit:
        return keyed.join(F.broadcast(ranges), ["level", "bin"]).drop("level", "bin")
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, ["level", "bin", "_salt"]).drop("level", "bin", "_salt")
