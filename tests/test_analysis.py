"""Slice comparison, contribution, concentration and sample-size rules on tiny frames."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import FACT_SCHEMA, days, order, spread_orders
from kpiscope.operators import compare as C
from kpiscope.sources.cases import cases_frame

BASE = days("2025-06-26", 14)
ANOM = days("2025-07-10", 8)
PAYMENT_CASE = [dict(case_id="T-1", kpi_name="order_count", start="2025-07-10", end="2025-07-17",
                     description="Order count dropped", cause="credit card gateway outage",
                     baseline=("2025-06-26", "2025-07-09"))]

# (slice, baseline orders over 14 days, anomaly orders over 8 days)
PAYMENT_COUNTS = [("credit_card", 1340, 398), ("debit_card", 280, 176), ("paypal", 280, 172),
                  ("apple_pay", 140, 90), ("bank_transfer", 141, 83)]


def payment_fact(spark):
    counter, rows = [0], []
    for s, b, a in PAYMENT_COUNTS:
        rows += spread_orders(counter, s, b, BASE)
        rows += spread_orders(counter, s, a, ANOM)
    return spark.createDataFrame(rows, FACT_SCHEMA)


def slices_for(spark, fact, cases, **kw):
    cube = C.daily_cube(fact, ["payment_type", "channel"])
    return C.slice_compare(cube, cases_frame(spark, cases), **kw)


def test_golden_contribution_arithmetic(spark):
    s = slices_for(spark, payment_fact(spark), PAYMENT_CASE)
    rows = {r["dimension_value"]: r for r in s.where("dimension = 'payment_type'").collect()}
    cc = rows["credit_card"]
    assert (cc["baseline_daily"], cc["anomaly_daily"]) == (95.71, 49.75)
    assert cc["absolute_change"] == -45.96
    assert cc["percent_change"] == -48.02
    assert cc["driver_rank"] == 1
    total = sum(r["absolute_change"] for r in rows.values())
    assert round(total, 2) == -40.91
    assert cc["contribution_pct"] == 112.34     # published: 112.3 %
    stats = C.contribution_stats(s).where("dimension = 'payment_type'").first()
    assert stats["total_change"] == -40.91 and stats["n_slices"] == 5 and stats["concentrated"]


def test_best_driver_is_credit_card_negative(spark):
    s = slices_for(spark, payment_fact(spark), PAYMENT_CASE)
    best = C.best_driver(s).collect()
    assert len(best) == 1
    assert best[0]["dimension"] == "payment_type" and best[0]["dimension_value"] == "credit_card"
    assert best[0]["absolute_change"] < 0


def test_zero_baseline_gives_zero_percent_and_total_zero_contribution(spark):
    rows = [order(1, ANOM[0], payment_type="new_slice"), order(2, dt.date(2025, 7, 9), payment_type="old"),
            order(3, ANOM[0], payment_type="old")]
    fact = spark.createDataFrame(rows, FACT_SCHEMA)
    cases = [dict(PAYMENT_CASE[0], baseline=("2025-07-09", "2025-07-09"),
                  start="2025-07-10", end="2025-07-10")]
    s = {r["dimension_value"]: r for r in
         slices_for(spark, fact, cases).where("dimension = 'payment_type'").collect()}
    assert s["new_slice"]["percent_change"] == 0.0
    assert s["new_slice"]["anomaly_daily"] == 1.0
    assert s["old"]["absolute_change"] == 0.0
    # channel: one slice, change 1.0 -> contribution 100; sum-zero case below
    ch = slices_for(spark, fact, cases).where("dimension = 'channel'").first()
    assert ch["contribution_pct"] == 100.0
    zero = spark.createDataFrame([order(1, dt.date(2025, 7, 9)), order(2, dt.date(2025, 7, 10))],
                                 FACT_SCHEMA)
    z = slices_for(spark, zero, cases).where("dimension = 'channel'").first()
    assert z["absolute_change"] == 0.0 and z["contribution_pct"] == 0.0


def test_windows_overlap_are_independent_masks(spark):
    # baseline 07-01..07-10 overlaps anomaly 07-10..07-11 on 07-10
    rows = [order(1, dt.date(2025, 7, 10)), order(2, dt.date(2025, 7, 1))]
    cases = [dict(PAYMENT_CASE[0], start="2025-07-10", end="2025-07-11",
                  baseline=("2025-07-01", "2025-07-10"))]
    s = slices_for(spark, spark.createDataFrame(rows, FACT_SCHEMA), cases).where(
        "dimension = 'channel'").first()
    assert s["sample_size_baseline"] == 2 and s["sample_size_anomaly"] == 1


def test_null_slices_dropped_and_empty_windows_give_no_rows(spark):
    rows = [order(1, ANOM[0], payment_type=None), order(2, ANOM[0])]
    s = slices_for(spark, spark.createDataFrame(rows, FACT_SCHEMA), PAYMENT_CASE)
    vals = [r["dimension_value"] for r in s.where("dimension = 'payment_type'").collect()]
    assert vals == ["credit_card"]
    far = spark.createDataFrame([order(1, dt.date(2020, 1, 1))], FACT_SCHEMA)
    assert slices_for(spark, far, PAYMENT_CASE).count() == 0


def test_mean_kpi_is_not_per_day(spark):
    rows = [order(1, BASE[0], total=10.0), order(2, BASE[1], total=30.0), order(3, ANOM[0], total=40.0)]
    s = slices_for(spark, spark.createDataFrame(rows, FACT_SCHEMA), PAYMENT_CASE,
                   metric="order_total", agg="mean").where("dimension = 'channel'").first()
    assert (s["baseline_daily"], s["anomaly_daily"], s["percent_change"]) == (20.0, 40.0, 100.0)


def _slices_frame(spark, rows):
    return spark.createDataFrame(
        [("c", "d", v, p, i + 1, 100, 80) for i, (v, p) in enumerate(rows)],
        "case_id string, dimension string, dimension_value string, contribution_pct double, "
        "driver_rank int, sample_size_baseline bigint, sample_size_anomaly bigint")


def test_concentration(spark):
    hi = C.concentration(_slices_frame(spark, [("a", 80.0), ("b", 15.0), ("c", 5.0)]), 1).first()
    assert hi["concentrated"] and hi["top_n_contribution_pct"] == 80.0 and hi["top_slices"] == "a"
    lo = C.concentration(_slices_frame(spark, [("a", 30.0), ("b", 35.0), ("c", 35.0)]), 1).first()
    assert not lo["concentrated"]
    top2 = C.concentration(_slices_frame(spark, [("a", 30.0), ("b", 35.0), ("c", -35.0)]), 2).first()
    assert top2["top_n_contribution_pct"] == 70.0 and top2["concentrated"]


def test_small_sample_flags(spark):
    df = spark.createDataFrame(
        [("c", "d", "a", 1, 100, 80), ("c", "d", "b", 2, 10, 5)],
        "case_id string, dimension string, dimension_value string, driver_rank int, "
        "sample_size_baseline bigint, sample_size_anomaly bigint")
    flags = C.small_sample_flags(df).collect()
    assert [f["flag"] for f in flags] == ["Small sample: b (baseline=10, anomaly=5)"]
    big = df.withColumn("sample_size_baseline", F.lit(50)).withColumn("sample_size_anomaly", F.lit(40))
    assert C.small_sample_flags(big).count() == 0


def test_default_baseline(spark):
    from kpiscope.operators.windows import with_baseline
    cases = [dict(PAYMENT_CASE[0], baseline=None, start="2025-03-10", end="2025-03-16"),
             dict(PAYMENT_CASE[0], case_id="T-2", baseline=None, start="2025-04-01", end="2025-04-30")]
    r = {x["case_id"]: x for x in with_baseline(cases_frame(spark, cases)).collect()}
    assert (str(r["T-1"]["baseline_start"]), str(r["T-1"]["baseline_end"])) == ("2025-02-24", "2025-03-09")
    assert r["T-2"]["baseline_days"] == 30 and str(r["T-2"]["baseline_end"]) == "2025-03-31"
