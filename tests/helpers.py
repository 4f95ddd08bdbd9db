"""Shared test helpers: tiny canonical order frames and result digests."""

import datetime as dt
import hashlib
import math

from pyspark.sql import types as T

FACT_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("order_date", T.DateType()),
    T.StructField("customer_id", T.LongType()), T.StructField("customer_type", T.StringType()),
    T.StructField("channel", T.StringType()), T.StructField("region", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("campaign", T.StringType()),
    T.StructField("payment_type", T.StringType()), T.StructField("order_total", T.DoubleType()),
    T.StructField("order_status", T.StringType()), T.StructField("is_cancelled", T.BooleanType()),
    T.StructField("is_refunded", T.BooleanType()), T.StructField("is_pending", T.BooleanType()),
    T.StructField("n_items", T.IntegerType()),
])


def order(order_id, day, payment_type="credit_card", total=10.0, channel="web", region="EU",
          category="books", customer_type="returning", refunded=False, cancelled=False):
    return (order_id, day, order_id, customer_type, channel, region, category, "none", payment_type,
            total, "completed", cancelled, refunded, False, 1)


def days(start, n):
    d0 = dt.date.fromisoformat(start)
    return [d0 + dt.timedelta(days=i) for i in range(n)]


def spread_orders(counter, slice_value, n, window_days, **kw):
    """n orders of one slice spread round-robin over the window's days."""
    rows = []
    for i in range(n):
        counter[0] += 1
        rows.append(order(counter[0], window_days[i % len(window_days)], payment_type=slice_value, **kw))
    return rows


def digest(cols, rows):
    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v
    order_ = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(norm(r[i]) for i in order_)) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines
