"""A customer owning a third of all orders; governed vs raw KPI modes."""

import os
import tempfile

import pandas as pd
import pyarrow.parquet as pq

from helpers import FACT_SCHEMA, days, order
from kpiscope.operators import compare as C
from kpiscope.sources.binding import canonical_orders
from kpiscope.sources.cases import cases_frame


def test_hot_customer(spark, sf_small):
    d = tempfile.mkdtemp(prefix="kpiscope-skew-")
    for t in ["region", "nation", "customer", "lineitem"]:
        pq.write_table(pq.read_table(os.path.join(sf_small, f"{t}.parquet")), os.path.join(d, f"{t}.parquet"))
    o = pq.read_table(os.path.join(sf_small, "orders.parquet")).to_pandas()
    hot = int(o["o_custkey"].iloc[0])
    o.loc[o.index % 3 == 0, "o_custkey"] = hot                # a third of all orders
    o.to_parquet(os.path.join(d, "orders.parquet"), index=False)
    got = {r["order_id"]: r["customer_type"] for r in canonical_orders(spark, d).select("order_id", "customer_type").collect()}
    first = o.sort_values(["o_orderdate", "o_orderkey"]).groupby("o_custkey")["o_orderkey"].first()
    new = set(first.tolist())
    assert {k for k, v in got.items() if v == "new"} == new
    assert sum(1 for v in got.values() if v == "returning") == len(o) - len(new)


def test_governed_mode_counts_paid_orders_only(spark):
    base, anom = days("2025-06-01", 14), days("2025-06-15", 14)
    rows, i = [], 0
    for dset, n_paid, n_cancel in ((base, 28, 0), (anom, 28, 14)):
        for k in range(n_paid + n_cancel):
            i += 1
            rows.append(order(i, dset[k % 14], total=10.0, cancelled=k >= n_paid))
    fact = spark.createDataFrame(rows, FACT_SCHEMA)
    cases = cases_frame(spark, [dict(case_id="G", kpi_name="gmv", start="2025-06-15", end="2025-06-28",
                                     description="", cause="")])
    cube = C.daily_cube(fact, ["channel"])
    raw = C.slice_compare(cube, cases).first()
    gov = C.slice_compare(cube, cases, mode="governed").first()
    assert (raw["baseline_daily"], raw["anomaly_daily"]) == (20.0, 30.0)     # all orders
    assert (gov["baseline_daily"], gov["anomaly_daily"]) == (20.0, 20.0)     # cancelled excluded
