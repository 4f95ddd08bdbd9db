"""Baseline-vs-anomaly comparison and slice contribution.

Plan shape (one job for all incidents and all dimensions)::

    fact --range filter (pushed to Parquet)--> unpivot dims (Expand)
         --> partial + final HashAggregate by (order_date, dimension, slice)
         = daily cube: exact integer measures, bounded by days x slices
    daily cube --> prefix sums by month (operators/prefix.py)
    prefix sums JOIN window ends ON month (four rows an incident, broadcast when
         few) --> HashAggregate by (case_id, dimension, slice): differences
         --> range-partitioned rank and totals by (case_id, dimension)
             (operators/ranking.py), no window over a dimension's slices

The fact is scanned once; the only shuffle of fact-sized data is the
map-side-combined daily cube. Whole-population figures use the pseudo
dimension ``__total__`` of the same cube.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.fixed import (CONCENTRATION_PCT, DIMENSIONS, MIN_SLICE_SAMPLE,
                                      TXT_CONCENTRATION, TXT_NO_CHANGE, TXT_SMALL_SAMPLE)
from kpiscope.functions.kpi import MEASURE_COLUMNS, fixed_measure, measure_aggs, pick_by_kpi
from kpiscope.functions.numeric import fmt_fixed, pct_change, round2
from kpiscope.operators.prefix import comparison_windows, lookups
from kpiscope.operators.ranking import with_rank
from kpiscope.operators.windows import with_baseline

TOTAL = "__total__"

_MEASURE_INPUTS = ["order_total", "is_refunded", "is_cancelled", "is_pending", "customer_type"]


def existing_dimensions(fact: DataFrame, dims) -> list[str]:
    """Keep requested dimensions that exist in the fact; warn on the rest."""
    missing = [d for d in dims if d not in fact.columns]
    if missing:
        logging.getLogger("kpiscope").warning("dimensions not found, skipped: %s", ", ".join(missing))
    return [d for d in dims if d in fact.columns]


def daily_cube(fact: DataFrame, dims=None, lo=None, hi=None) -> DataFrame:
    """(order_date, dimension, slice) -> base measures, plus dimension '__total__'. A NULL slice is
    a group of its own; slice analysis leaves it out, breakdowns keep it."""
    dims = existing_dimensions(fact, dims or DIMENSIONS)
    f = fact
    if lo is not None:
        f = f.where(F.col("order_date").between(F.lit(lo), F.lit(hi)))
    f = f.select("order_date", *[F.col(c).alias(f"m_{c}") for c in _MEASURE_INPUTS],
                 *[F.col(d).cast("string").alias(d) for d in dims],
                 F.lit(TOTAL).alias(TOTAL))
    long = f.unpivot(["order_date"] + [f"m_{c}" for c in _MEASURE_INPUTS],
                     dims + [TOTAL], "dimension", "slice")
    long = long.withColumnsRenamed({f"m_{c}": c for c in _MEASURE_INPUTS})
    return long.groupBy("order_date", "dimension", "slice").agg(*measure_aggs())


def _window_value(agg: Column, s: Column, n: Column, days: Column) -> Column:
    return (F.when(agg == "sum", s / days)
             .when(agg == "mean", F.when(n > 0, s / n).otherwise(F.lit(0.0)))
             .otherwise(n.cast("double") / days))


def window_sums(cube: DataFrame, cases: DataFrame, metric: str | None = None,
                agg: str | None = None, mode: str = "raw") -> DataFrame:
    """Per (case, dimension, slice): exact baseline / anomaly sums and counts.

    ``metric``/``agg`` fix the measure for every incident; when omitted each
    incident's KPI picks it from the registry (``mode`` raw or governed).
    """
    met = lookups(cube, comparison_windows(cases), cases)
    if metric is None:
        kpi = F.col("kpi_name")
        s, n = pick_by_kpi(kpi, mode, "sum"), pick_by_kpi(kpi, mode, "cnt")
        scale, a = pick_by_kpi(kpi, mode, "scale"), pick_by_kpi(kpi, mode, "agg")
    else:
        s, n = fixed_measure(metric, "sum"), fixed_measure(metric, "cnt")
        scale, a = fixed_measure(metric, "scale"), F.lit(agg)
    met = met.select("case_id", "kpi_name", "baseline_days", "anomaly_days", "window",
                     "dimension", "slice", "n_rows", s.alias("s"), n.alias("n"),
                     scale.alias("scale"), a.alias("agg"))
    sums = (met.groupBy("case_id", "kpi_name", "agg", "scale", "baseline_days", "anomaly_days",
                        "dimension", "slice").agg(*_both_windows(["s", "n", "n_rows"])))
    return sums.where((F.col("bl_n_rows") > 0) | (F.col("an_n_rows") > 0)).drop("bl_n_rows", "an_n_rows")


def _both_windows(measures: list[str]) -> list[Column]:
    bl, an = F.col("window") == "baseline", F.col("window") == "anomaly"
    return [F.sum(F.when(w, F.col(m))).alias(f"{name}_{m}") for m in measures for name, w in (("bl", bl), ("an", an))]


def _with_values(ws: DataFrame) -> DataFrame:
    agg, scale = F.col("agg"), F.col("scale")
    bl_s = F.coalesce(F.col("bl_s"), F.lit(0)).cast("double") / scale
    an_s = F.coalesce(F.col("an_s"), F.lit(0)).cast("double") / scale
    bl_n = F.coalesce(F.col("bl_n"), F.lit(0))
    an_n = F.coalesce(F.col("an_n"), F.lit(0))
    return ws.withColumns({
        "bl_val": _window_value(agg, bl_s, bl_n, F.col("baseline_days")),
        "an_val": _window_value(agg, an_s, an_n, F.col("anomaly_days")),
        "sample_size_baseline": bl_n.cast("bigint"),
        "sample_size_anomaly": an_n.cast("bigint")})


def window_compare(cube: DataFrame, cases: DataFrame, metric: str | list[str] | None = "order_total",
                   agg: str = "sum", mode: str = "raw") -> DataFrame:
    """Whole-population comparison of every incident; windows without orders count as zero.

    A list of metrics gives a row for each incident and metric from one pass over the cube; None
    takes the metric and aggregation of each incident's KPI.
    """
    whole = cube.where(F.col("dimension") == TOTAL)
    every = with_baseline(cases).select("case_id", "kpi_name", "baseline_days", "anomaly_days")
    sums = (lookups(whole, comparison_windows(cases), cases).groupBy("case_id").agg(*_both_windows(MEASURE_COLUMNS)))
    j = every.join(sums, "case_id", "left")

    def part(name: str, pick) -> Column:
        """One metric's sums, counts, scale and aggregation; ``pick`` chooses a column of a window."""
        def of(window: str, what: str) -> Column:
            return F.coalesce(pick(window, what), F.lit(0)).cast("bigint").alias(f"{window}_{'s' if what == 'sum' else 'n'}")
        return F.struct(F.lit(name).alias("metric"), of("bl", "sum"), of("bl", "cnt"), of("an", "sum"), of("an", "cnt"),
                        pick("bl", "scale").alias("scale"), pick("bl", "agg").alias("agg"))

    if metric is None:
        parts = [part("kpi", lambda w, what: pick_by_kpi(F.col("kpi_name"), mode, what, f"{w}_"))]
    else:
        names = [metric] if isinstance(metric, str) else list(metric)
        parts = [part(m, lambda w, what, m=m: fixed_measure(m, what, agg, f"{w}_")) for m in names]
    v = _with_values(j.select("case_id", "baseline_days", "anomaly_days", F.explode(F.array(*parts)).alias("p"))
                     .select("case_id", "baseline_days", "anomaly_days", "p.*"))
    return v.select(
        "case_id", "metric",
        F.col("baseline_days").cast("int").alias("baseline_days"),
        F.col("anomaly_days").cast("int").alias("anomaly_days"),
        round2("bl_val").alias("baseline_daily"), round2("an_val").alias("anomaly_daily"),
        round2(F.col("an_val") - F.col("bl_val")).alias("absolute_change"),
        round2(pct_change("an_val", "bl_val")).alias("percent_change"))


def slice_values(cube: DataFrame, cases: DataFrame, metric: str | None = None,
                 agg: str | None = None, mode: str = "raw") -> DataFrame:
    """Both windows' values of every slice, and the change in whole hundredths, unranked."""
    ws = window_sums(cube.where((F.col("dimension") != TOTAL) & F.col("slice").isNotNull()), cases, metric, agg, mode)
    chg_c = F.round((F.col("an_val") - F.col("bl_val")) * F.lit(100.0)).cast("bigint")
    return _with_values(ws).withColumn("chg_c", chg_c).select(
        "case_id", "kpi_name", "dimension", "slice", "bl_val", "an_val", "chg_c",
        "sample_size_baseline", "sample_size_anomaly")


def slice_compare(cube: DataFrame, cases: DataFrame, metric: str | None = None,
                  agg: str | None = None, mode: str = "raw") -> DataFrame:
    """A11 + W1 + W2 for every incident and dimension of the cube.

    Rounded values feed later steps exactly as in the reference: the change is
    rounded from unrounded daily values, the contribution uses rounded changes
    (kept as whole hundredths so their total is exact).
    """
    v = with_rank(slice_values(cube, cases, metric, agg, mode), ["case_id", "dimension"],
                  [F.abs(F.col("chg_c")).desc(), F.col("slice").asc()], "driver_rank", {"total_c": F.col("chg_c")}, "slices")
    total_c = F.col("total_c")
    contribution = F.when(total_c != 0,
                          round2(F.col("chg_c").cast("double") / total_c.cast("double") * F.lit(100.0))
                          ).otherwise(F.lit(0.0))
    return v.select(
        "case_id", "kpi_name", "dimension", F.col("slice").alias("dimension_value"),
        round2("bl_val").alias("baseline_daily"), round2("an_val").alias("anomaly_daily"),
        (F.col("chg_c").cast("double") / F.lit(100.0)).alias("absolute_change"),
        round2(pct_change("an_val", "bl_val")).alias("percent_change"),
        "sample_size_baseline", "sample_size_anomaly",
        contribution.alias("contribution_pct"),
        "driver_rank",
        "chg_c")


def contribution_stats(slices: DataFrame) -> DataFrame:
    """A12 summary per (case, dimension): total change, slice count, top-1 share."""
    top1 = F.max(F.when(F.col("driver_rank") == 1, F.abs(F.col("contribution_pct"))))
    s = (slices.groupBy("case_id", "dimension")
               .agg((F.sum("chg_c").cast("double") / F.lit(100.0)).alias("total_change"),
                    F.count(F.lit(1)).alias("n_slices"),
                    round2(top1).alias("top_1_contribution_pct")))
    return s.withColumn("concentrated", F.col("top_1_contribution_pct") > F.lit(CONCENTRATION_PCT))


def top_drivers(slices: DataFrame) -> DataFrame:
    """Rank-1 slice of every (case, dimension), with its dimension position."""
    pos = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))
    return slices.where(F.col("driver_rank") == 1).withColumn("dim_pos", pos)


def best_driver(slices: DataFrame) -> DataFrame:
    """Per case the top driver with strictly largest |contribution|, ties
    to the earlier dimension in plan order; none when every share is 0."""
    td = top_drivers(slices).where(F.col("contribution_pct") != 0)
    w = Window.partitionBy("case_id").orderBy(F.abs(F.col("contribution_pct")).desc(),
                                              F.col("dim_pos").asc())
    return (td.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
              .select("case_id", "dimension", "dimension_value", "percent_change",
                      "contribution_pct", "baseline_daily", "anomaly_daily", "absolute_change"))


def concentration(slices: DataFrame, top_n: int = 1) -> DataFrame:
    """Share of the n slices with the largest |contribution| per dimension."""
    # only top_n rows of each group survive the group limit before the exchange
    w = Window.partitionBy("case_id", "dimension").orderBy(
        F.abs(F.col("contribution_pct")).desc(), F.col("dimension_value").asc())
    first = slices.withColumn("crank", F.row_number().over(w)).where(F.col("crank") <= top_n)
    tops = first.groupBy("case_id", "dimension").agg(
        F.sum(F.abs(F.col("contribution_pct"))).alias("top_sum"),
        F.sort_array(F.collect_list(F.struct("crank", "dimension_value"))).alias("tops"))
    sizes = slices.groupBy("case_id", "dimension").agg(F.count(F.lit(1)).alias("total_slices"))
    g = sizes.join(tops, ["case_id", "dimension"])
    return g.select(
        "case_id", "dimension", F.lit(top_n).alias("top_n"),
        round2("top_sum").alias("top_n_contribution_pct"),
        "total_slices",
        (F.col("top_sum") > F.lit(CONCENTRATION_PCT)).alias("concentrated"),
        F.concat_ws("; ", F.transform("tops", lambda t: t["dimension_value"])).alias("top_slices"),
        F.when(F.col("top_sum") > 0,
               F.format_string(TXT_CONCENTRATION, F.lit(top_n), fmt_fixed("top_sum", 1)))
         .otherwise(F.lit(TXT_NO_CHANGE)).alias("detail"))


def small_sample_flags(slices: DataFrame, min_count: int = MIN_SLICE_SAMPLE) -> DataFrame:
    """V2: slices with fewer than ``min_count`` rows in either window."""
    small = (F.col("sample_size_anomaly") < min_count) | (F.col("sample_size_baseline") < min_count)
    return (slices.where(small)
                  .select("case_id", "dimension", "dimension_value", "driver_rank",
                          "sample_size_baseline", "sample_size_anomaly",
                          F.format_string(TXT_SMALL_SAMPLE,
                                          F.col("dimension_value"), F.col("sample_size_baseline"),
                                          F.col("sample_size_anomaly")).alias("flag")))
