"""Incident windows: default baseline (V0), window calendars, interval tagging.

A window is a date range. Range joins plan as nested loops, so each window is
exploded to its days and joined on the date with an equi-join instead. The
calendar holds (incidents x window days) rows; it is broadcast only after its
size has been measured, otherwise it is shuffled like any other side. Tagging (J5)
of more incidents cuts windows into dyadic ranges instead (operators/intervals.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.dates import inclusive_days
from kpiscope.functions.fixed import DEFAULT_BASELINE_DAYS
from kpiscope.operators import intervals

# Largest calendar (rows) that is broadcast; above it the join shuffles.
BROADCAST_CALENDAR_ROWS = 1_000_000   # about 60 MB


def with_baseline(cases: DataFrame) -> DataFrame:
    """V0: fill the baseline window when either end is missing.

    Length max(anomaly days, 14), ending the day before the anomaly starts.
    """
    start, end = F.col("affected_start_date"), F.col("affected_end_date")
    n = inclusive_days(start, end)
    default_end = F.date_sub(start, 1)
    default_start = F.date_sub(default_end, F.greatest(n, F.lit(DEFAULT_BASELINE_DAYS)) - 1)
    missing = F.col("baseline_start").isNull() | F.col("baseline_end").isNull()
    bs = F.when(missing, default_start).otherwise(F.col("baseline_start"))
    be = F.when(missing, default_end).otherwise(F.col("baseline_end"))
    return cases.withColumns({"baseline_start": bs, "baseline_end": be,
                              "baseline_days": inclusive_days(bs, be),
                              "anomaly_days": inclusive_days(start, end)})


def _days(lo: Column, hi: Column) -> Column:
    """The days of a range; none when it ends before it starts (a plain sequence would count down)."""
    return F.when(lo <= hi, F.sequence(lo, hi))


def window_calendar(cases: DataFrame) -> DataFrame:
    """(case_id, window, order_date): one row per day of each window.

    The two windows are independent masks: a day inside both yields two rows.
    """
    c = with_baseline(cases)
    windows = F.array(
        F.struct(F.lit("baseline").alias("window"), F.col("baseline_start").alias("lo"),
                 F.col("baseline_end").alias("hi")),
        F.struct(F.lit("anomaly").alias("window"), F.col("affected_start_date").alias("lo"),
                 F.col("affected_end_date").alias("hi")))
    return (c.select("case_id", "kpi_name", "baseline_days", "anomaly_days",
                     F.explode(windows).alias("w"))
             .select("case_id", "kpi_name", "baseline_days", "anomaly_days",
                     F.col("w.window").alias("window"),
                     F.explode(_days(F.col("w.lo"), F.col("w.hi"))).alias("order_date")))


def label_calendar(cases: DataFrame) -> DataFrame:
    """Every day of [baseline_start, anomaly_end], labelled 'anomaly' inside
    the anomaly window and 'baseline' otherwise (gap days count as baseline)."""
    c = with_baseline(cases)
    d = F.col("order_date")
    return (c.select("case_id", "affected_start_date", "affected_end_date",
                     F.explode(_days(F.col("baseline_start"), F.col("affected_end_date"))).alias("order_date"))
             .select("case_id", "order_date",
                     F.when(d.between(F.col("affected_start_date"), F.col("affected_end_date")), "anomaly")
                      .otherwise("baseline").alias("time_window")))


def calendar_rows(cases: DataFrame) -> int:
    """Size check for the calendar: one tiny aggregate over the incident table
    (remembered on the incident DataFrame, so a plan pays for it once)."""
    cached = getattr(cases, "_calendar_rows", None)
    if cached is not None:
        return cached
    c = with_baseline(cases)
    zero = F.lit(0)
    labelled = F.datediff("affected_end_date", "baseline_start") + 1     # the label calendar holds gap days too
    row = c.agg(F.sum(F.greatest(F.greatest("baseline_days", zero) + F.greatest("anomaly_days", zero), labelled))
                .alias("n")).first()
    n = int(row["n"] or 0)
    try:
        cases._calendar_rows = n
    except AttributeError:
        pass
    return n


def join_calendar(facts: DataFrame, calendar: DataFrame, cases: DataFrame,
                  limit: int = BROADCAST_CALENDAR_ROWS) -> DataFrame:
    """Equi-join on order_date; broadcast the calendar only when measured small."""
    side = F.broadcast(calendar) if calendar_rows(cases) <= limit else calendar
    return facts.join(side, "order_date")


def incident_tagging(orders: DataFrame, cases: DataFrame, limit: int = BROADCAST_CALENDAR_ROWS) -> DataFrame:
    """Orders inside an incident's affected window that also satisfy the
    incident's optional slice predicate (channel / region / category /
    payment_type / campaign, each null-or-equal; all given ones must hold).

    Calendars of up to ``limit`` days are broadcast; beyond it the windows become dyadic ranges."""
    c = cases.select(
        "case_id", "affected_start_date", "affected_end_date",
        F.col("injection.type").alias("injection_type"),
        F.col("injection.channel").alias("i_channel"), F.col("injection.region").alias("i_region"),
        F.col("injection.category").alias("i_category"),
        F.col("injection.payment_type").alias("i_payment_type"),
        F.col("injection.campaign").alias("i_campaign"))
    if calendar_rows(cases) <= limit:
        days = c.select("*", F.explode(_days(F.col("affected_start_date"), F.col("affected_end_date"))).alias("order_date"))
        j = orders.join(F.broadcast(days), "order_date")
    else:
        j = intervals.interval_join(orders, c, "order_date", "affected_start_date", "affected_end_date", "order_id",
                                    limit=intervals.BROADCAST_RANGES)
    cond = F.lit(True)
    for dim in ["channel", "region", "category", "payment_type", "campaign"]:
        cond = cond & (F.col(f"i_{dim}").isNull() | (F.col(f"i_{dim}") == F.col(dim)))
    return j.where(cond).select("case_id", "injection_type", "order_id", "order_date",
                                "channel", "region", "category", "payment_type", "campaign",
                                "order_total")


def window_bounds_of(cases: DataFrame):
    """Literal (min, max) date over all baseline and anomaly windows of an
    incident DataFrame: one tiny aggregate, so the fact scan gets a pushed
    range filter even when the incidents come from a file."""
    c = with_baseline(cases)
    r = c.agg(F.least(F.min("baseline_start"), F.min("affected_start_date")).alias("lo"),
              F.greatest(F.max("baseline_end"), F.max("affected_end_date")).alias("hi")).first()
    return r["lo"], r["hi"]
