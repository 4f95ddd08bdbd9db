"""Physical-plan properties that matter at scale."""

from kpiscope.plans import base as B
from kpiscope.operators import retrieval as RT
from kpiscope.sources.tables import read_table
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contribution_plan(spark, sf_small):
    from kpiscope.operators import compare as C
    p = plan_of(C.slice_values(B.cube(spark, sf_small), B.incidents(spark)))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "BroadcastHashJoin" in p                    # window ends broadcast after the size check
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p
    assert "Expand" in p                               # unpivot before the partial aggregate
    assert "GreaterThanOrEqual(o_orderdate" in p       # window range pushed to the orders scan
    assert p.count("explode(sequence(") == 1           # months of slices; no window is exploded to days
    ranked = plan_of(B.slices(spark, sf_small))
    assert "Window" not in ranked.replace("Window [sum(_n", "").replace("Window [sum(total_c", "")


def test_bm25_postings_meet_only_query_terms(spark, sf_small):
    ix = RT.BM25Index(RT.documents_as_chunks(read_table(spark, sf_small, "documents")), materialized=False)
    q = read_table(spark, sf_small, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    p = plan_of(ix.scores(q))
    assert "BroadcastHashJoin" in p and "NestedLoopJoin" not in p
    assert "NestedLoopJoin" not in plan_of(ix.top_k(q))
    # one join of the postings, whose other side are the query terms with their idf
    terms = RT.query_terms(q).select("term").distinct()
    assert p.count("idf") > 0 and ix.tf.join(terms, "term", "left_semi").count() < ix.tf.count()


def test_first_orders_use_hash_aggregates(spark, sf_small):
    from kpiscope.sources.binding import first_orders
    p = plan_of(first_orders(read_table(spark, sf_small, "orders")))
    assert "SortAggregate" not in p and "Window" not in p


def _scans(plan, table):
    return plan.count(f"{table}.parquet")


def test_fact_joins_only_what_its_columns_need(spark, sf_small):
    from kpiscope.plans import catalog
    for key in ("daily_series", "gmv_weekly", "gmv_monthly", "seasonal_adjusted_volume"):
        p = plan_of(catalog.QUERIES[key](spark, sf_small))
        assert _scans(p, "orders") == 1 and "Join" not in p and p.count("Exchange hashpartitioning") == 1, key
    p = plan_of(catalog.QUERIES["customer_type_derive"](spark, sf_small))
    assert _scans(p, "orders") == 2 and _scans(p, "lineitem") == _scans(p, "customer") == 0
    p = plan_of(catalog.QUERIES["window_filter"](spark, sf_small))
    assert _scans(p, "orders") == 1 and _scans(p, "lineitem") == 0


def test_first_order_by_date_then_key(spark):
    import datetime as dt
    from kpiscope.sources.binding import first_orders
    day = dt.datetime
    rows = [(5, 1, day(2020, 1, 2)), (9, 1, day(2020, 1, 1, 3)), (7, 1, day(2020, 1, 1, 2)), (8, 1, day(2020, 1, 1, 2)),
            (2 ** 63 - 1, 2, day(1950, 5, 5)), (-4, None, day(2021, 1, 1)), (3, None, day(2021, 1, 1)), (11, 3, None)]
    frame = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    assert {r[0] for r in first_orders(frame).collect()} == {7, 2 ** 63 - 1, -4}
