"""The bucketed layout: J1 without an exchange, equal rows."""

import pytest

from kpiscope.sources import binding as SB
from kpiscope.sources.bucketed import lay_out

COLUMNS = ["order_id", "order_date", "order_total", "order_status", "n_items"]


@pytest.fixture
def layout(spark, sf_small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = lay_out(spark, sf_small, 6)
    yield out
    out.drop(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_j1_has_no_exchange_on_either_side(spark, sf_small, layout):
    plain, bucketed = SB.enriched_orders(spark, sf_small, COLUMNS), SB.enriched_orders(spark, layout, COLUMNS)
    assert plan_of(plain).count("Exchange hashpartitioning") == 2
    assert "Exchange" not in plan_of(bucketed) and plan_of(bucketed).count("Bucketed: true") == 2
    assert rows_of(bucketed) == rows_of(plain)


def test_whole_fact_is_shuffled_for_the_customer_only(spark, sf_small, layout):
    bucketed = SB.enriched_orders(spark, layout)
    assert "Exchange hashpartitioning(l_orderkey" not in plan_of(bucketed) and "Exchange hashpartitioning(o_orderkey" not in plan_of(bucketed)
    assert rows_of(bucketed) == rows_of(SB.enriched_orders(spark, sf_small))


def test_refunds_and_payments_by_bucket(spark, sf_small, layout):
    for make in (SB.refunds, lambda s, d: SB.line_facts(s, d)):
        assert "Exchange" not in plan_of(make(spark, layout)) and rows_of(make(spark, layout)) == rows_of(make(spark, sf_small))


def test_missing_tables_are_empty_in_buckets(spark, tmp_path):
    empty = lay_out(spark, str(tmp_path), 3)
    assert SB.enriched_orders(spark, empty).count() == 0
    empty.drop(spark)
