"""KPI registry.

Every KPI is evaluated from a handful of *base measures* kept at daily grain as
exact integers (cents, counts). A base measure has a sum column and a
non-null count column; a KPI picks one base measure and an aggregation:

* ``sum``   -> window sum / inclusive days       (daily rate)
* ``mean``  -> window sum / window count         (not per day)
* ``count`` -> window count / inclusive days

Two modes:

* ``raw`` reproduces the slice analysis of the reference: all orders, the
  order total for money KPIs, the refund / cancel flags for rates.
* ``governed`` follows the written metric definitions: paid orders only for
  GMV, revenue, AOV and order count; new-customer ratio as a real ratio.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiscope.functions.numeric import to_cents


@dataclass(frozen=True)
class Measure:
    name: str
    sum_col: str | None     # daily-cube column with the exact sum (None: count only)
    cnt_col: str            # daily-cube column with the non-null count
    cents: bool             # sum is in cents


MEASURES = {
    "order_total": Measure("order_total", "amt_c", "n_total", True),
    "is_refunded": Measure("is_refunded", "s_ref", "n_ref", False),
    "is_cancelled": Measure("is_cancelled", "s_can", "n_can", False),
    "customer_type": Measure("customer_type", None, "n_ct", False),
    "paid_total": Measure("paid_total", "paid_c", "n_paid", True),
    "is_new": Measure("is_new", "s_new", "n_new", False),
}

KPIS = {
    "raw": {
        "gmv": ("order_total", "sum"),
        "order_count": ("order_total", "count"),
        "aov": ("order_total", "mean"),
        "revenue": ("order_total", "sum"),
        "refund_rate": ("is_refunded", "mean"),
        "cancellation_rate": ("is_cancelled", "mean"),
        "new_customer_ratio": ("customer_type", "count"),
        "conversion_rate": ("order_total", "count"),
    },
    "governed": {
        "gmv": ("paid_total", "sum"),
        "order_count": ("paid_total", "count"),
        "aov": ("paid_total", "mean"),
        "revenue": ("paid_total", "sum"),
        "refund_rate": ("is_refunded", "mean"),
        "cancellation_rate": ("is_cancelled", "mean"),
        "new_customer_ratio": ("is_new", "mean"),
        "conversion_rate": ("order_total", "count"),
    },
}
DEFAULT_KPI = ("order_total", "sum")


def measure_aggs() -> list[Column]:
    """Aggregates that build every base measure from canonical order rows."""
    paid = ~F.col("is_cancelled") & ~F.col("is_pending")
    flag = lambda c: F.col(c).cast("int")
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count("order_total").alias("n_total"),
        F.sum(to_cents("order_total")).alias("amt_c"),
        F.count("is_refunded").alias("n_ref"),
        F.sum(flag("is_refunded")).alias("s_ref"),
        F.count("is_cancelled").alias("n_can"),
        F.sum(flag("is_cancelled")).alias("s_can"),
        F.count("customer_type").alias("n_ct"),
        F.count(F.when(paid, F.col("order_total"))).alias("n_paid"),
        F.sum(F.when(paid, to_cents("order_total"))).alias("paid_c"),
        F.count("customer_type").alias("n_new"),
        F.sum((F.col("customer_type") == "new").cast("int")).alias("s_new"),
    ]


MEASURE_COLUMNS = ["n_rows", "n_total", "amt_c", "n_ref", "s_ref", "n_can", "s_can", "n_ct",
                   "n_paid", "paid_c", "n_new", "s_new"]


def _measure_part(m: Measure, agg: str, what: str, prefix: str = "") -> Column:
    if what == "sum":    # exact integer sum; divide by 'scale' after aggregating
        return F.col(prefix + m.sum_col).cast("bigint") if m.sum_col else F.lit(None).cast("bigint")
    if what == "cnt":
        return F.col(prefix + m.cnt_col).cast("bigint")
    if what == "scale":
        return F.lit(100.0 if m.cents else 1.0)
    return F.lit(agg)


def kpi_spec(kpi_name: str, mode: str = "raw") -> tuple[str, str]:
    return KPIS[mode].get(kpi_name, DEFAULT_KPI)


def pick_by_kpi(kpi_col: Column, mode: str, what: str, prefix: str = "") -> Column:
    """Per-row choice, by the incident's KPI name, of the base measure's
    window sum ('sum'), its count ('cnt'), the divisor that turns the sum into
    units ('scale') or the aggregation name ('agg'); ``prefix`` begins the measure columns' names."""
    expr = None
    for kpi, (metric, agg) in KPIS[mode].items():
        val = _measure_part(MEASURES[metric], agg, what, prefix)
        expr = F.when(kpi_col == kpi, val) if expr is None else expr.when(kpi_col == kpi, val)
    metric, agg = DEFAULT_KPI
    return expr.otherwise(_measure_part(MEASURES[metric], agg, what, prefix))


def fixed_measure(metric: str, what: str, agg: str = "sum", prefix: str = "") -> Column:
    return _measure_part(MEASURES[metric], agg, what, prefix)
