"""Time-window and period roll-ups (A8, A9, A13-A17) and display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.fixed import CHART_TOP_N, REPORT_DRIVER_ROWS
from kpiscope.functions.numeric import cents_to_money, fmt_fixed, to_cents
from kpiscope.operators.compare import TOTAL
from kpiscope.operators.views import paid_predicate
from kpiscope.operators.prefix import labelled_windows, lookups
from kpiscope.operators.ranking import with_rank


def _by_label(cube: DataFrame, cases: DataFrame, *by: str) -> DataFrame:
    """Order count, GMV and AOV of each label (P4), from the prefix sums; labels without orders have no row."""
    n, amt, priced = F.col("n_rows"), F.col("amt_c"), F.col("n_total")
    sums = lookups(cube, labelled_windows(cases), cases).groupBy("case_id", *by, "time_window").agg(
        *[F.sum(m).alias(m) for m in ("n_rows", "amt_c", "n_total")])
    gmv = F.when(priced > 0, cents_to_money(amt))
    return sums.where(n > 0).select("case_id", *by, "time_window", n.alias("order_count"), gmv.alias("gmv"),
                                    F.try_divide(gmv, priced.cast("double")).alias("aov"))


def agg_by_time_window(cube: DataFrame, cases: DataFrame) -> DataFrame:
    """Per incident and label (P4): order count, GMV, AOV over
    [baseline_start, anomaly_end]; computed from the daily cube."""
    return _by_label(cube.where(F.col("dimension") == TOTAL), cases)


def agg_by_dim_window(cube: DataFrame, cases: DataFrame, dims=("channel", "region"), ranked: bool = True) -> DataFrame:
    """Dimension x label breakdown, ranked by GMV desc nulls last (O2)."""
    g = _by_label(cube.where(F.col("dimension").isin(*dims)), cases, "dimension", "slice")
    order = [F.col("gmv").desc_nulls_last(), F.col("slice").asc_nulls_last(), F.col("time_window").asc()]
    return with_rank(g, ["case_id", "dimension"], order, "gmv_rank", name="breakdown") if ranked else g


def daily_series(orders: DataFrame) -> DataFrame:
    """Σ order_total per date."""
    return (orders.groupBy("order_date")
                  .agg(cents_to_money(F.sum(to_cents("order_total"))).alias("value")))


def daily_series_by_group(orders: DataFrame, group: str = "channel") -> DataFrame:
    """A13 grouped variant: the rows of one series per group value."""
    return orders.select(F.col(group).alias("series"), "order_date",
                         F.col("order_total").alias("value"))


def order_rollup(items: DataFrame) -> DataFrame:
    """Σ quantity x unit price rounded to cents, and item count, per order."""
    line_c = F.round(F.col("quantity") * F.col("unit_price") * F.lit(100.0)).cast("bigint")
    return (items.groupBy("order_id")
                 .agg(cents_to_money(F.sum(line_c)).alias("order_total"),
                      F.count(F.lit(1)).alias("n_items")))


def gmv_by_period(orders: DataFrame, unit: str) -> DataFrame:
    """GMV / paid orders / AOV per week or month, from paid orders only
    (period ratios come from period sums, never from averaged daily ratios)."""
    p = orders.where(paid_predicate()).withColumn("period", F.to_date(F.date_trunc(unit, "order_date")))
    amt = F.sum(to_cents("order_total"))
    return (p.groupBy("period")
             .agg(cents_to_money(amt).alias("gmv"), F.count(F.lit(1)).alias("paid_orders"),
                  (cents_to_money(amt) / F.count(F.lit(1)).cast("double")).alias("aov")))


def net_revenue_monthly(orders: DataFrame, refunds: DataFrame) -> DataFrame:
    """Net revenue = GMV - refunds, per month (full outer on the period)."""
    g = (orders.where(paid_predicate()).groupBy(F.to_date(F.date_trunc("month", "order_date")).alias("period"))
               .agg(F.sum(to_cents("order_total")).alias("gmv_c")))
    r = (refunds.groupBy(F.to_date(F.date_trunc("month", "refund_date")).alias("period"))
                .agg(F.sum(to_cents("refund_amount")).alias("ref_c")))
    j = g.join(r, "period", "full_outer")
    gmv_c, ref_c = F.coalesce("gmv_c", F.lit(0)), F.coalesce("ref_c", F.lit(0))
    return j.select("period", cents_to_money(gmv_c).alias("gmv"),
                    cents_to_money(ref_c).alias("refunds"),
                    cents_to_money(gmv_c - ref_c).alias("net_revenue"))


def aov_median(orders: DataFrame, bucket_width: float = 10_000.0) -> DataFrame:
    """Exact median order value of paid orders per month.

    Two-level selection, so no task ever holds a whole month:
    1. counts per (month, value bucket) -> the bucket(s) holding the two
       middle ranks (tiny: months x buckets);
    2. only those buckets' values -> (month, value) counts -> running rank
       inside the bucket. A window partition holds the distinct values of one
       bucket, bounded by the bucket width, whatever the order volume.
    Linear interpolation between the two middle ranks (as percentile 0.5).
    """
    p = (orders.where(paid_predicate()).where(F.col("order_total").isNotNull())
               .select(F.to_date(F.date_trunc("month", "order_date")).alias("period"),
                       F.col("order_total").alias("v"))
               .withColumn("b", F.floor(F.col("v") / F.lit(bucket_width))))
    bc = p.groupBy("period", "b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("period").orderBy("b")
    bc = (bc.withColumn("cum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("n", F.sum("c").over(Window.partitionBy("period"))))
    pos = (F.col("n") - 1).cast("double") * F.lit(0.5)
    bc = bc.withColumn("lo_i", F.floor(pos)).withColumn("hi_i", F.ceil(pos)).withColumn("frac", pos - F.floor(pos))
    start = F.col("cum") - F.col("c")
    holds = lambda r: (start <= F.col(r)) & (F.col("cum") > F.col(r))
    targets = (bc.where(holds("lo_i") | holds("hi_i"))
                 .select("period", "b", start.alias("offset"), "lo_i", "hi_i", "frac", "n"))
    # at most two buckets per month: a broadcast side of bounded size
    vals = (p.join(F.broadcast(targets), ["period", "b"])
              .groupBy("period", "b", "offset", "lo_i", "hi_i", "frac", "n", "v")
              .agg(F.count(F.lit(1)).alias("c")))
    wv = Window.partitionBy("period", "b").orderBy("v")
    vals = vals.withColumn("cum", F.col("offset") + F.sum("c").over(wv.rowsBetween(Window.unboundedPreceding, 0)))
    vstart = F.col("cum") - F.col("c")
    at = lambda r: (vstart <= F.col(r)) & (F.col("cum") > F.col(r))
    g = (vals.groupBy("period")
             .agg(F.max(F.when(at("lo_i"), F.col("v"))).alias("v_lo"),
                  F.max(F.when(at("hi_i"), F.col("v"))).alias("v_hi"),
                  F.max("frac").alias("frac"), F.max("n").alias("paid_orders")))
    return g.select("period", "paid_orders",
                    (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("median_aov"))


def chart_contribution_rows(slices: DataFrame, top_n: int = CHART_TOP_N) -> DataFrame:
    """Top drivers per (case, dimension) with sign colour and label."""
    return (slices.where(F.col("driver_rank") <= top_n)
                  .select("case_id", "dimension", "dimension_value", "contribution_pct",
                          F.col("driver_rank").cast("bigint").alias("driver_rank"),
                          F.when(F.col("contribution_pct") < 0, "negative").otherwise("positive")
                           .alias("bar_sign"),
                          F.concat(fmt_fixed("contribution_pct", 1, sign=True), F.lit("%"))
                           .alias("bar_label")))


def report_driver_rows(slices: DataFrame, top_n: int = REPORT_DRIVER_ROWS) -> DataFrame:
    """The report table rows (top drivers per dimension, formatted)."""
    return (slices.where(F.col("driver_rank") <= top_n)
                  .select("case_id", "dimension", F.col("driver_rank").cast("bigint").alias("driver_rank"),
                          F.col("dimension_value").alias("slice"),
                          F.format_string("%.2f", F.col("baseline_daily")).alias("baseline"),
                          F.format_string("%.2f", F.col("anomaly_daily")).alias("anomaly"),
                          F.format_string("%+.2f", F.col("absolute_change")).alias("change"),
                          F.concat(fmt_fixed("percent_change", 1, sign=True), F.lit("%")).alias("pct_change"),
                          F.concat(fmt_fixed("contribution_pct", 1), F.lit("%")).alias("contribution")))
