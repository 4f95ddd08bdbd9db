"""Prefix sums of the daily cube: a window is the difference of two lookups.

The daily cube holds a row for each (date, dimension, slice). Its running sums are built in two
levels: within a month by a window of at most 31 rows, and over months by a window over the month
totals, whose sum before a month is that month's offset. A row of the result is one month of one
slice: the offset ``base`` and the month's days with their running sums. Months without rows are
filled in up to the last month that any window ends in, so the running sum up to a date is one
equi-join on the month: ``base`` plus the last day of the month that is not after the date.

The sum over a window [lo, hi] is the sum up to hi minus the sum up to lo - 1. An incident with two
windows therefore costs four lookups for each slice, whatever the length of its windows, where a
calendar exploded to days costs one row a day. All sums are integers, so both ways agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.kpi import MEASURE_COLUMNS
from kpiscope.operators.windows import with_baseline

# Largest table of incidents whose window ends (four rows of under 100 bytes each) are broadcast; above it the join shuffles.
BROADCAST_CASES = 100_000

_KEYS = ["dimension", "slice"]


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def case_extent(cases: DataFrame) -> tuple[int, int]:
    """Number of incidents and the last month that one of their windows ends in: one aggregate over
    the incident table, remembered on it so that a plan pays for it once."""
    known = getattr(cases, "_case_extent", None)
    if known is None:
        c = with_baseline(cases)
        row = c.agg(F.count(F.lit(1)).alias("n"),
                    F.max(month_number(F.greatest("baseline_end", "affected_end_date"))).alias("m")).first()
        known = int(row["n"]), int(row["m"] or 0)
        cases._case_extent = known
    return known


def is_prefix(cube: DataFrame) -> bool:
    return "base" in cube.columns


def prefix_cube(cube: DataFrame, last_month: int) -> DataFrame:
    """(dimension, slice, month) -> ``base``, the sums before the month, and ``days``, the running sums in it.

    All steps share one exchange of the cube by (dimension, slice). A null slice is a group of its own;
    rows without a date are in no window.
    """
    if is_prefix(cube):
        return cube
    measures = MEASURE_COLUMNS
    daily = cube.where(F.col("order_date").isNotNull()).select(
        *_KEYS, "order_date", month_number(F.col("order_date")).alias("month"),
        *[F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias(m) for m in measures]).repartition(*[F.col(k) for k in _KEYS])
    in_month = (Window.partitionBy(*_KEYS, "month").orderBy("order_date")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = daily.select(*_KEYS, "month", F.struct(
        F.col("order_date").alias("day"), *[F.sum(m).over(in_month).alias(m) for m in measures]).alias("d"))
    months = running.groupBy(*_KEYS, "month").agg(F.sort_array(F.collect_list("d")).alias("days"))
    last = F.element_at("days", -1)
    by_month = Window.partitionBy(*_KEYS).orderBy("month")
    before = by_month.rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(
        *_KEYS, "month", "days", F.lead("month").over(by_month).alias("next"),
        F.struct(*[F.coalesce(F.sum(last[m]).over(before), F.lit(0)).alias(m) for m in measures]).alias("base"))
    until = F.greatest(F.coalesce(F.col("next") - 1, F.lit(last_month)), F.col("month"))
    filled = months.select("*", F.explode(F.sequence("month", until)).alias("at"))
    own = F.col("at") == F.col("month")
    return filled.select(
        *_KEYS, F.col("at").alias("month"),
        F.when(own, F.col("base")).otherwise(
            F.struct(*[(F.col("base")[m] + last[m]).alias(m) for m in measures])).alias("base"),
        F.when(own, F.col("days")).otherwise(F.slice("days", 1, 0)).alias("days"))


def comparison_windows(cases: DataFrame) -> DataFrame:
    """The baseline and the anomaly window of each incident: independent masks that may overlap."""
    c = with_baseline(cases)
    windows = F.array(
        F.struct(F.lit("baseline").alias("window"), F.col("baseline_start").alias("lo"), F.col("baseline_end").alias("hi")),
        F.struct(F.lit("anomaly").alias("window"), F.col("affected_start_date").alias("lo"),
                 F.col("affected_end_date").alias("hi")))
    return (c.select("case_id", "kpi_name", "baseline_days", "anomaly_days", F.explode(windows).alias("w"))
            .select("case_id", "kpi_name", "baseline_days", "anomaly_days", "w.*"))


def labelled_windows(cases: DataFrame) -> DataFrame:
    """[baseline_start, anomaly end] of each incident as two ranges: 'anomaly' from the anomaly's
    start on, 'baseline' before it (gap days count as baseline)."""
    c = with_baseline(cases)
    start, end, first = F.col("affected_start_date"), F.col("affected_end_date"), F.col("baseline_start")
    windows = F.array(
        F.struct(F.lit("baseline").alias("time_window"), first.alias("lo"), F.least(F.date_sub(start, 1), end).alias("hi")),
        F.struct(F.lit("anomaly").alias("time_window"), F.greatest(first, start).alias("lo"), end.alias("hi")))
    return c.select("case_id", F.explode(windows).alias("w")).select("case_id", "w.*")


def lookups(cube: DataFrame, windows: DataFrame, cases: DataFrame, limit: int = BROADCAST_CASES) -> DataFrame:
    """The windows' columns but for lo and hi, dimension, slice, and every measure, signed: the sum of a
    measure over the rows of a window and slice is its sum in that window.

    ``cube`` is a daily cube or its prefix form. A window that ends before it starts has no rows.
    """
    n_cases, last_month = case_extent(cases)
    prefix = prefix_cube(cube, last_month)
    kept = [c for c in windows.columns if c not in ("lo", "hi")]
    ends = F.array(F.struct(F.lit(1).alias("sign"), F.col("hi").alias("day")),
                   F.struct(F.lit(-1).alias("sign"), F.date_sub("lo", 1).alias("day")))
    ends = (windows.where(F.col("lo") <= F.col("hi")).select(*kept, F.explode(ends).alias("e"))
            .select(*kept, F.col("e.sign").alias("sign"), F.col("e.day").alias("end_day"),
                    month_number(F.col("e.day")).alias("month")))
    met = prefix.join(F.broadcast(ends) if n_cases <= limit else ends, "month")
    met = met.withColumn("d", F.try_element_at(F.filter("days", lambda d: d["day"] <= F.col("end_day")), F.lit(-1)))
    return met.select(*kept, *_KEYS, *[
        (F.col("sign") * (F.col("base")[m] + F.coalesce(F.col("d")[m], F.lit(0)))).alias(m) for m in MEASURE_COLUMNS])
