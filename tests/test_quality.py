"""Key integrity, rule violations and their plans."""

import datetime as dt

from pyspark.sql import functions as F

from kpiscope.operators import quality as Q
from kpiscope.plans import catalog


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_kind_of_fault_is_counted(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id long")
    child = spark.createDataFrame([(1, "R"), (1, "A"), (9, "R"), (9, "R"), (8, "A"), (None, "R"), (None, None)], "fk long, flag string")
    every = F.lit(True)
    rows = {r["table_name"]: r.asDict() for r in Q.key_integrity("id", [
        (parent, F.col("id"), {"p": every}),
        (child, F.col("fk"), {"c": every, "r": F.coalesce(F.col("flag") == "R", F.lit(False))})], "p").collect()}
    facts = lambda n: [rows[n][k] for k in ("n_rows", "n_keys", "n_duplicate_keys", "n_null_keys", "n_orphans")]
    assert facts("p") == [5, 4, 1, 1, 0]
    assert facts("c") == [7, 4, 3, 1, 3]
    assert facts("r") == [4, 3, 1, 1, 2]
    assert rows["p"]["key_column"] == "id"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long")
    row = Q.key_integrity("id", [(none, F.col("id"), {"t": F.lit(True)})]).collect()
    assert [tuple(r)[2:] for r in row] == [(0, 0, 0, 0, 0)]


def test_two_spellings_of_a_name_are_a_duplicate(spark):
    df = spark.createDataFrame([("Web", "x"), ("web ", "x"), ("web ", "y"), ("store", None)], "channel string, campaign string")
    rows = {r["table_name"]: tuple(r)[2:] for r in Q.name_integrity(df, ["channel", "campaign"], ["channels", "campaigns"]).collect()}
    assert rows == {"channels": (3, 2, 1, 0), "campaigns": (3, 3, 0, 1)}


def test_every_rule_can_fail(spark):
    day = dt.date(2025, 1, 10)
    rows = [(1, day, 10.0, "refunded", 11.0, day + dt.timedelta(days=3), "O", 10.0, "completed"),
            (2, day, 10.0, "refunded", 5.0, day, "X", 10.0, "odd"),
            (3, day, 10.0, "lost", 0.0, None, None, 10.0, "pending"), (3, day, 10.0, "completed", 0.0, None, None, 4.0, "failed"),
            (4, None, None, None, 0.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "order_id long, order_date date, order_total double, order_status string, refund_amount double, "
                                     "refund_date date, refund_reason string, payment_amount double, payment_status string")
    got = {r["rule"]: r["n_violations"] for r in Q.rule_violations(df, ["O", "F"], ["completed", "refunded"]).collect()}
    assert got == dict.fromkeys(Q.RULES, 1)


def test_plans_scan_a_table_once_for_each_key(spark, sf_small):
    scans = lambda p, t: p.count(f"{t}.parquet")
    p = plan_of(catalog.QUERIES["dq_pk"](spark, sf_small))
    assert (scans(p, "orders"), scans(p, "lineitem"), scans(p, "customer"), scans(p, "part")) == (2, 1, 1, 1) and "Join" not in p
    p = plan_of(catalog.QUERIES["dq_orphans"](spark, sf_small))
    assert (scans(p, "orders"), scans(p, "lineitem"), scans(p, "customer"), scans(p, "part")) == (2, 2, 1, 1) and "Join" not in p
    assert p.count("Exchange hashpartitioning") == 3
    p = plan_of(catalog.QUERIES["dq_rules"](spark, sf_small))
    assert (scans(p, "orders"), scans(p, "lineitem"), scans(p, "customer")) == (1, 1, 0) and "NestedLoop" not in p
    assert p.count("Exchange hashpartitioning") == 2


def test_views_join_only_what_they_read(spark, sf_small):
    for key, customer, lines in (("daily_kpi_summary", 0, 1), ("channel_performance", 0, 1), ("category_performance", 1, 1),
                                 ("region_performance", 1, 1), ("customer_segment_performance", 0, 0)):
        p = plan_of(catalog.QUERIES[key](spark, sf_small))
        assert p.count("customer.parquet") == customer and p.count("lineitem.parquet") == lines, key
        assert p.count("nation.parquet") == customer
