"""The stored cube: only changed parts are read, and it equals a full rebuild."""

import datetime as dt
import re
import uuid

import pytest
from helpers import FACT_SCHEMA, days, digest, order

from kpiscope.operators import compare as C
from kpiscope.sources import cube_store as S
from kpiscope.sources.sinks import scratch_path

DIMS = ["channel", "region"]


def rows_for(day_list, at=0, **kw):
    return [order(at + i, d, channel=("web", "app")[i % 2], total=float(i), **kw) for i, d in enumerate(list(day_list) * 3)]


def same(cube, rows, spark):
    want = C.daily_cube(spark.createDataFrame(rows, FACT_SCHEMA), DIMS)
    assert sorted(cube.columns) == sorted(want.columns)
    cols = sorted(cube.columns)
    return digest(cols, [tuple(r[c] for c in cols) for r in cube.collect()]) == digest(cols, [tuple(r[c] for c in cols) for r in want.collect()])


@pytest.fixture
def paths(spark):
    base = scratch_path(spark, f"cube-{uuid.uuid4().hex}")
    return f"{base}/fact", f"{base}/cube"


def refresh(spark, paths, **kw):
    return S.refresh_cube(spark, *paths, FACT_SCHEMA, dims=DIMS, **kw)


def test_one_new_day_is_the_only_one_read(spark, paths):
    rows = rows_for(days("2024-03-01", 6)) + rows_for([None])
    S.write_fact(spark.createDataFrame(rows, FACT_SCHEMA), paths[0])
    first = refresh(spark, paths)
    assert len(first.parts) == 7 and S.NO_DATE in first.parts and same(first.cube, rows, spark)
    assert refresh(spark, paths).parts == []
    new = rows_for(days("2024-03-07", 1), 100)
    S.write_fact(spark.createDataFrame(new, FACT_SCHEMA), paths[0], mode="append")
    stale = S.stale_parts(spark, *paths)
    read = S.stale_facts(spark, paths[0], FACT_SCHEMA, stale)
    assert stale == ["2024-03-07"] and read.count() == len(new)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*part", plan) and "PushedFilters: []" in plan
    again = refresh(spark, paths)
    assert again.parts == stale and same(again.cube, rows + new, spark)


def test_rows_added_to_an_old_day_and_a_lost_day(spark, paths):
    rows = rows_for(days("2024-03-01", 4))
    S.write_fact(spark.createDataFrame(rows, FACT_SCHEMA), paths[0])
    refresh(spark, paths)
    late = rows_for(days("2024-03-02", 1), 200, region="US")
    S.write_fact(spark.createDataFrame(late, FACT_SCHEMA), paths[0], mode="append")
    got = refresh(spark, paths)
    assert got.parts == ["2024-03-02"] and same(got.cube, rows + late, spark)
    kept = [r for r in rows if r[1] != dt.date(2024, 3, 3)]
    S.write_fact(spark.createDataFrame(kept, FACT_SCHEMA), paths[0])
    got = refresh(spark, paths)
    assert "2024-03-03" not in got.parts and same(got.cube, kept, spark)


def test_months_and_an_empty_fact(spark, paths):
    assert refresh(spark, paths).cube.count() == 0
    rows = rows_for(days("2024-01-25", 15))
    S.write_fact(spark.createDataFrame(rows, FACT_SCHEMA), paths[0], S.MONTH)
    got = refresh(spark, paths, pattern=S.MONTH)
    assert got.parts == ["2024-01", "2024-02"] and same(got.cube, rows, spark)


def test_a_lost_state_rebuilds_everything(spark, paths):
    rows = rows_for(days("2024-03-01", 3))
    S.write_fact(spark.createDataFrame(rows, FACT_SCHEMA), paths[0])
    refresh(spark, paths)
    other = (paths[0], paths[1] + "-2")
    assert len(S.stale_parts(spark, *other)) == 3 and same(refresh(spark, other).cube, rows, spark)
