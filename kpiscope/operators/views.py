"""Curated views (J1, A1-A6) as DataFrame functions.

Money is summed in whole cents and divided once, so every engine and every
partitioning returns the same value. Views carry no ORDER BY (O1): ordering
is the consumer's business and a sorted view gives no guarantee downstream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.functions.numeric import cents_to_money, safe_ratio, to_cents

def paid_predicate() -> Column:
    """Not cancelled and not pending."""
    return ~F.col("is_cancelled") & ~F.col("is_pending")


def _rate(flag: Column) -> Column:
    return safe_ratio(F.sum(flag.cast("int")), F.count(F.lit(1)))


def kpi_aggs(names) -> list[Column]:
    paid = paid_predicate()
    paid_c = F.sum(F.when(paid, to_cents("order_total")))
    n_paid = F.count_if(paid)
    defs = {
        "total_orders": F.count(F.lit(1)),
        "paid_orders": n_paid,
        "gmv": cents_to_money(paid_c),
        "aov": F.try_divide(cents_to_money(paid_c), n_paid.cast("double")),
        "refund_rate": _rate(F.col("is_refunded")),
        "cancellation_rate": _rate(F.col("is_cancelled")),
        "new_customer_ratio": _rate(F.col("customer_type") == "new"),
        "revenue": cents_to_money(paid_c),
    }
    return [defs[n].alias(n) for n in names]


def fact_orders_enriched(orders: DataFrame, refunds: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders LEFT JOIN refunds LEFT JOIN payments on order_id.

    Three fact-sized inputs joined on the same key: Spark shuffles each once
    by order_id and the second join reuses the first join's partitioning.
    """
    r = refunds.select(F.col("order_id").alias("r_order_id"), "refund_amount", "refund_date",
                       F.col("reason").alias("refund_reason"))
    p = payments.select(F.col("order_id").alias("p_order_id"),
                        F.col("amount").alias("payment_amount"), "payment_status")
    j = (orders.join(r, orders.order_id == r.r_order_id, "left")
               .join(p, orders.order_id == p.p_order_id, "left"))
    return j.select(
        "order_id", "order_date", "customer_id", "customer_type", "channel", "region", "category",
        "campaign", "payment_type", "order_total", "order_status", "is_cancelled", "is_refunded",
        "is_pending", "n_items",
        F.coalesce(F.col("refund_amount"), F.lit(0.0)).alias("refund_amount"),
        "refund_date", "refund_reason", "payment_amount", "payment_status")


def daily_kpi_summary(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date").agg(*kpi_aggs(
        ["total_orders", "paid_orders", "gmv", "aov", "refund_rate", "cancellation_rate",
         "new_customer_ratio", "revenue"]))


def channel_performance(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date", "channel").agg(*kpi_aggs(
        ["total_orders", "paid_orders", "gmv", "aov", "refund_rate", "new_customer_ratio"]))


def category_performance(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date", "category").agg(*kpi_aggs(
        ["total_orders", "paid_orders", "gmv", "aov", "refund_rate", "cancellation_rate"]))


def region_performance(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date", "region").agg(*kpi_aggs(
        ["total_orders", "paid_orders", "gmv", "aov", "refund_rate"]))


def customer_segment_performance(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date", "customer_type", "channel").agg(*kpi_aggs(
        ["total_orders", "paid_orders", "gmv", "aov"]))


def refund_summary(refunds: DataFrame, orders: DataFrame) -> DataFrame:
    """A6 with J2: refunds INNER JOIN orders, grouped by date, slice and reason."""
    o = orders.select(F.col("order_id").alias("o_id"), "category", "region", "channel")
    j = refunds.join(o, refunds.order_id == o.o_id)
    amt_c = F.sum(to_cents("refund_amount"))
    return (j.groupBy("refund_date", "category", "region", "channel",
                      F.col("reason").alias("refund_reason"))
             .agg(F.count(F.lit(1)).alias("refund_count"),
                  cents_to_money(amt_c).alias("total_refund_amount"),
                  (cents_to_money(amt_c) / F.count(F.lit(1)).cast("double")).alias("avg_refund_amount")))


VIEW_BUILDERS = {
    "daily_kpi_summary": lambda t: daily_kpi_summary(t["orders"]),
    "fact_orders_enriched": lambda t: fact_orders_enriched(t["orders"], t["refunds"], t["payments"]),
    "channel_performance": lambda t: channel_performance(t["orders"]),
    "category_performance": lambda t: category_performance(t["orders"]),
    "region_performance": lambda t: region_performance(t["orders"]),
    "customer_segment_performance": lambda t: customer_segment_performance(t["orders"]),
    "refund_summary": lambda t: refund_summary(t["refunds"], t["orders"]),
}


_KPI_COLUMNS = ["order_date", "order_total", "is_cancelled", "is_pending"]
# columns of the canonical orders that each roll-up reads; only the tables that these come from are joined
VIEW_COLUMNS = {
    "daily_kpi_summary": [*_KPI_COLUMNS, "is_refunded", "customer_type"],
    "channel_performance": [*_KPI_COLUMNS, "channel", "is_refunded", "customer_type"],
    "category_performance": [*_KPI_COLUMNS, "category", "is_refunded"],
    "region_performance": [*_KPI_COLUMNS, "region", "is_refunded"],
    "customer_segment_performance": [*_KPI_COLUMNS, "customer_type", "channel"],
}


def register_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Register the canonical tables and the seven views as temp views."""
    from kpiscope.sources import binding as b
    tables = {"orders": b.canonical_orders(spark, sf_dir), "refunds": b.refunds(spark, sf_dir),
              "payments": b.payments(spark, sf_dir)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    b.products(spark, sf_dir).createOrReplaceTempView("products")
    b.order_items(spark, sf_dir).createOrReplaceTempView("order_items")
    b.customers(spark, sf_dir).createOrReplaceTempView("customers")
    for name, build in VIEW_BUILDERS.items():
        build(tables).createOrReplaceTempView(name)
    # for this binding the enriched fact and the refund summary come from one
    # line roll-up (refunds and payments are one per order)
    enriched = b.enriched_orders(spark, sf_dir)
    enriched.createOrReplaceTempView("fact_orders_enriched")
    refund_summary_from_enriched(enriched).createOrReplaceTempView("refund_summary")
    return list(VIEW_BUILDERS)


def refund_summary_from_enriched(enriched: DataFrame) -> DataFrame:
    """A6 from the enriched fact (one refund per refunded order)."""
    r = enriched.where(F.col("refund_reason").isNotNull())
    amt_c = F.sum(to_cents("refund_amount"))
    return (r.groupBy("refund_date", "category", "region", "channel", "refund_reason")
             .agg(F.count(F.lit(1)).alias("refund_count"),
                  cents_to_money(amt_c).alias("total_refund_amount"),
                  (cents_to_money(amt_c) / F.count(F.lit(1)).cast("double")).alias("avg_refund_amount")))
