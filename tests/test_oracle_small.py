"""Registered queries against their DuckDB SQL on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from helpers import digest

KEYS = ["scan_orders_canonical", "contribution_multi_dim", "kpi_by_dim_governed", "window_compare_mean",
        "daily_kpi_summary", "fact_orders_enriched", "refund_summary", "agg_by_dim_window",
        "aov_median", "bm25_topk", "sql_audit", "cause_tokens", "dq_rules",
        "investigate_all", "evidence_registry", "grade_cases", "report_driver_rows",
        "default_baseline", "analysis_row_counts", "driver_rank", "agg_by_time_window", "case_subset"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "benchmark"]


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_small, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_small, con, key):
    df = E.queries()[key](spark, sf_small)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_a_callable_and_entry_runs(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.count() >= 0 and "case_id" in df.columns
