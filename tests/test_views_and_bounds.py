"""Governed daily view on a tiny frame; incident bounds and calendar size agree across sides."""

import datetime as dt

from helpers import FACT_SCHEMA, order
from kpiscope.operators import views as V
from kpiscope.operators.windows import calendar_rows, window_bounds_of
from kpiscope.sources.cases import DEFAULT_CASES, calendar_size, cases_frame, window_bounds


def test_daily_kpi_summary_semantics(spark):
    d = dt.date(2025, 1, 1)
    rows = [order(1, d, total=10.0), order(2, d, total=30.0, refunded=True),
            order(3, d, total=50.0, cancelled=True), order(4, d, total=70.0, customer_type="new")]
    pend = list(order(5, d, total=90.0)); pend[13] = True        # is_pending
    fact = spark.createDataFrame(rows + [tuple(pend)], FACT_SCHEMA)
    r = V.daily_kpi_summary(fact).first()
    assert r["total_orders"] == 5 and r["paid_orders"] == 3
    assert r["gmv"] == 110.0 and r["revenue"] == 110.0            # paid only: 10 + 30 + 70
    assert abs(r["aov"] - 110.0 / 3) < 1e-12
    assert r["refund_rate"] == 0.2 and r["cancellation_rate"] == 0.2 and r["new_customer_ratio"] == 0.2


def test_bounds_and_calendar_size_agree(spark):
    df = cases_frame(spark)
    assert window_bounds_of(df) == window_bounds(DEFAULT_CASES)
    plain = spark.createDataFrame(df.rdd, df.schema)               # no precomputed size
    assert calendar_rows(plain) == calendar_size(DEFAULT_CASES)
