"""Canonical star schema derived from the driver's TPC-H style tables.

| canonical                 | derived from                                              |
|---------------------------|-----------------------------------------------------------|
| order_id, customer_id     | o_orderkey, o_custkey                                      |
| order_date, order_total   | to_date(o_orderdate), o_totalprice                         |
| is_cancelled / is_pending | o_orderstatus = 'F' / = 'P'                                |
| is_refunded               | not cancelled and some line has l_returnflag = 'R'         |
| order_status              | cancelled > pending > refunded > completed (P5)            |
| channel                   | o_orderpriority                                            |
| region / category         | r_name / c_mktsegment (through the customer)               |
| payment_type              | n_name (the high-cardinality dimension)                    |
| customer_type             | 'new' for the customer's first order, else 'returning' (W4) |
| campaign                  | campaign calendar on order_date (C1)                       |
| n_items                   | number of lines                                            |
| refunds                   | refunded orders: last ship date, net line value, linestatus |
| payments                  | one per order with lines: gross line value, status by P5   |
| order_items / products    | lineitem / part                                            |

Money derived from lines is summed in whole cents so it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.functions.dates import campaign_of
from kpiscope.functions.numeric import cents_to_money, to_cents
from kpiscope.operators.heavy import key_join
from kpiscope.sources.tables import read_table


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order roll-up of lineitem (partial aggregation before the shuffle)."""
    li = read_table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    gross = net * (F.lit(1.0) + F.col("l_tax"))
    return (li.groupBy(F.col("l_orderkey").alias("order_id"))
              .agg(F.count(F.lit(1)).alias("n_lines"),
                   F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("has_return"),
                   F.max(F.to_date("l_shipdate")).alias("last_ship_date"),
                   F.sum(to_cents(net)).alias("net_c"),
                   F.sum(to_cents(gross)).alias("gross_c"),
                   # any open line -> 'O', else 'F' (a hash-aggregatable max)
                   F.when(F.max((F.col("l_linestatus") == "O").cast("int")) == 1, "O")
                    .otherwise("F").alias("max_linestatus")))


def customer_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> region / category / payment_type.

    nation (25 rows) and region (5 rows) have a fixed size by definition of
    the schema, so they are broadcast; the customer side is never broadcast
    by hand (AQE may, after measuring it).
    """
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    geo = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                      .select("n_nationkey", "n_name", "r_name"))
    cust = read_table(spark, sf_dir, "customer")
    return (cust.join(geo, cust.c_nationkey == geo.n_nationkey, "left")
                .select(F.col("c_custkey").alias("customer_id"),
                        F.col("r_name").alias("region"),
                        F.col("c_mktsegment").alias("category"),
                        F.col("n_name").alias("payment_type")))


KEY_RANGE = 10 ** 20      # above every unsigned 64-bit key


def first_orders(orders: DataFrame) -> DataFrame:
    """Order id of each customer's first order (by date, then id).

    One pass: the smallest (seconds, key) of a customer, packed into one
    decimal(38,0), which a hash aggregate can hold; partial aggregation keeps a
    customer owning a third of all orders from landing in one task.
    """
    whole = "decimal(38,0)"
    day = F.to_date("o_orderdate")
    seconds = (F.unix_date(day).cast("long") * 86400 + F.hour("o_orderdate") * 3600
               + F.minute("o_orderdate") * 60 + F.second("o_orderdate"))
    offset = F.lit(str(2 ** 63)).cast("decimal(20,0)")
    packed = (seconds.cast("decimal(15,0)") * F.lit(str(KEY_RANGE)).cast("decimal(21,0)")
              + (F.col("o_orderkey").cast("decimal(20,0)") + offset)).cast(whole)
    first = orders.groupBy("o_custkey").agg(F.min(packed).alias("first"))
    key = F.pmod(F.col("first"), F.lit(str(KEY_RANGE)).cast(whole)) - offset
    return first.where("first is not null").select(key.cast("long").alias("first_order_id"))


_FROM_CUSTOMER = {"region", "category", "payment_type"}
_FROM_LINES = {"order_status", "is_refunded", "n_items"}
_FROM_FIRSTS = {"customer_type"}


def _order_base(spark: SparkSession, sf_dir: str, line_cols, wanted: set[str] | None = None,
                salted: bool | None = None) -> DataFrame:
    """Orders with what the wanted canonical columns are read from, and no other join. The customer side is
    the one whose key may be hot; ``salted`` is that of ``key_join``."""
    o = read_table(spark, sf_dir, "orders")
    base = o                                # joins on the order key come first: they share one partitioning, or buckets
    if wanted is None or wanted & _FROM_LINES:
        lf = line_facts(spark, sf_dir).select("order_id", *line_cols)
        base = base.join(lf, o.o_orderkey == lf.order_id, "left")
    if wanted is None or wanted & _FROM_FIRSTS:
        firsts = first_orders(o)
        base = base.join(firsts, o.o_orderkey == firsts.first_order_id, "left")
    if wanted is None or wanted & _FROM_CUSTOMER:
        base = key_join(base, customer_dims(spark, sf_dir), "o_custkey", "customer_id", "o_orderkey", salted=salted, measured=o)
    return base


def _canonical_columns() -> dict:
    is_cancelled = F.col("o_orderstatus") == "F"
    is_pending = F.col("o_orderstatus") == "P"
    is_refunded = ~is_cancelled & (F.coalesce(F.col("has_return"), F.lit(0)) == 1)
    order_date = F.to_date("o_orderdate")
    return {
        "order_id": F.col("o_orderkey"),
        "order_date": order_date,
        "customer_id": F.col("o_custkey"),
        "customer_type": F.when(F.col("first_order_id").isNotNull(), "new").otherwise("returning"),
        "channel": F.col("o_orderpriority"),
        "region": F.col("region"),
        "category": F.col("category"),
        "campaign": campaign_of(order_date),
        "payment_type": F.col("payment_type"),
        "order_total": F.col("o_totalprice"),
        "order_status": F.when(is_cancelled, "cancelled").when(is_pending, "pending")
                         .when(is_refunded, "refunded").otherwise("completed"),
        "is_cancelled": is_cancelled,
        "is_refunded": is_refunded,
        "is_pending": is_pending,
        "n_items": F.coalesce(F.col("n_lines"), F.lit(0)).cast("int"),
    }


def _aliased(columns=None) -> list:
    return [c.alias(n) for n, c in _canonical_columns().items() if columns is None or n in columns]


def canonical_orders(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """The canonical orders, or only the named columns of them: then only the tables that these are
    read from are joined (Catalyst cannot drop a left join whose other side it cannot prove unique)."""
    wanted = None if columns is None else set(columns)
    return _order_base(spark, sf_dir, ["n_lines", "has_return"], wanted).select(*_aliased(wanted))


def enriched_orders(spark: SparkSession, sf_dir: str, columns=None, salted: bool | None = None) -> DataFrame:
    """J1 for this binding in one pass: refunds and payments are derived one
    per order from the same line roll-up, so instead of two more lineitem
    aggregations and two left joins, the roll-up is joined once and the
    refund / payment columns are read off it (same rows, same values).
    ``columns`` names the canonical columns that are wanted beside those."""
    wanted = None if columns is None else set(columns)
    base = _order_base(spark, sf_dir, ["n_lines", "has_return", "last_ship_date", "net_c", "gross_c", "max_linestatus"],
                       None if wanted is None else wanted | _FROM_LINES, salted)
    refunded = (F.col("has_return") == 1) & (F.col("o_orderstatus") != "F")
    has_lines = F.col("n_lines").isNotNull()
    return base.select(
        *_aliased(wanted),
        F.when(refunded, cents_to_money("net_c")).otherwise(F.lit(0.0)).alias("refund_amount"),
        F.when(refunded, F.col("last_ship_date")).alias("refund_date"),
        F.when(refunded, F.col("max_linestatus")).alias("refund_reason"),
        F.when(has_lines, cents_to_money("gross_c")).alias("payment_amount"),
        F.when(has_lines, F.when(F.col("o_orderstatus") == "F", "failed")
               .when(F.col("o_orderstatus") == "P", "pending").otherwise("completed"))
         .alias("payment_status"))


def _line_value(tax: bool):
    net = F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
    return cents_to_money(to_cents(net * (F.lit(1.0) + F.col("l_tax")) if tax else net))


def line_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One refund for each returned line, so an order can have several."""
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return li.select(F.col("l_orderkey").alias("order_id"), F.to_date("l_shipdate").alias("refund_date"),
                     _line_value(False).alias("refund_amount"), F.col("l_linestatus").alias("reason"))


def line_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payment for each line, open lines pending."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("order_id"), _line_value(True).alias("amount"),
                     F.when(F.col("l_linestatus") == "O", "pending").otherwise("completed").alias("payment_status"))


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lf = line_facts(spark, sf_dir)
    return (lf.join(o, lf.order_id == o.o_orderkey)
              .where((F.col("has_return") == 1) & (F.col("o_orderstatus") != "F"))
              .select(F.col("order_id").alias("refund_id"), "order_id",
                      F.col("last_ship_date").alias("refund_date"),
                      cents_to_money("net_c").alias("refund_amount"),
                      F.col("max_linestatus").alias("reason")))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    cust = customer_dims(spark, sf_dir).select("customer_id", "payment_type")
    lf = line_facts(spark, sf_dir).select("order_id", "gross_c")
    return (lf.join(o, lf.order_id == o.o_orderkey)
              .join(cust, o.o_custkey == cust.customer_id, "left")
              .select(F.col("order_id").alias("payment_id"), "order_id", "payment_type",
                      cents_to_money("gross_c").alias("amount"),
                      F.when(F.col("o_orderstatus") == "F", "failed")
                       .when(F.col("o_orderstatus") == "P", "pending")
                       .otherwise("completed").alias("payment_status"),
                      F.to_date("o_orderdate").alias("payment_date")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"), F.col("p_retailprice").alias("base_price"))


def order_items(spark: SparkSession, sf_dir: str, salted: bool | None = None) -> DataFrame:
    """Line items priced from the product list (J8: a shuffle join on product_id; AQE broadcasts the
    product side when it measures small). A product may be hot; ``salted`` is that of ``key_join``."""
    li = read_table(spark, sf_dir, "lineitem")
    prod = products(spark, sf_dir).select("product_id", "base_price")
    return (key_join(li, prod, "l_partkey", "product_id", "l_orderkey", salted=salted)
              .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
                      F.col("l_orderkey").alias("order_id"),
                      F.col("l_partkey").alias("product_id"),
                      F.col("l_quantity").cast("int").alias("quantity"),
                      F.col("base_price").alias("unit_price"),
                      F.col("l_extendedprice").alias("line_total")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, signup_date (first order date), region, acquisition_channel
    (channel of the first order); first orders come from the skew-safe
    aggregates of first_orders()."""
    o = read_table(spark, sf_dir, "orders")
    firsts = first_orders(o)
    first = (o.join(firsts, o.o_orderkey == firsts.first_order_id)
              .select("o_custkey", F.to_date("o_orderdate").alias("signup_date"),
                      F.col("o_orderpriority").alias("acquisition_channel")))
    cust = customer_dims(spark, sf_dir)
    return (cust.join(first, cust.customer_id == first.o_custkey, "left")
                .select("customer_id", "signup_date", "region", "acquisition_channel"))
