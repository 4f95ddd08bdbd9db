"""Dyadic ranges and the interval join against plain range conditions."""

import datetime as dt
import random

import pytest
from helpers import FACT_SCHEMA, order
from pyspark.sql import functions as F

from kpiscope.operators import intervals as I
from kpiscope.operators import windows as W
from kpiscope.sources.cases import cases_frame

EPOCH = dt.date(1970, 1, 1)


def day(n):
    return EPOCH + dt.timedelta(days=n)


def windows_of(spark, spans):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(spans)], "w int, lo date, hi date")


def test_ranges_are_aligned_disjoint_and_few(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.choice([0, 1, 2, 3, 6, 30, 364, 1000, 9999])) for a in (rng.randrange(-3000, 20000) for _ in range(400))]
    got = {}
    for r in I.dyadic_ranges(windows_of(spark, [(day(a), day(b)) for a, b in spans]), "lo", "hi").collect():
        got.setdefault(r["w"], []).append((r["level"], r["bin"]))
    for w, (a, b) in enumerate(spans):
        covered = sorted(d for level, at in got[w] for d in range(at << level, (at + 1) << level))
        assert covered == list(range(a, b + 1))
        assert len(got[w]) <= 2 * max(1, (b - a + 1).bit_length())
        assert max(sum(level == k for level, _ in got[w]) for k in range(23)) <= 2


@pytest.mark.parametrize("limit", [0, 10_000])
def test_join_equals_a_range_condition(spark, limit):
    rng = random.Random(5)
    spans = [(day(a), day(a + rng.choice([-3, 0, 1, 6, 90, 400]))) for a in (rng.randrange(-500, 900) for _ in range(60))]
    spans += [(None, day(5)), (day(5), None), spans[0], (day(0), day(0))]
    days = [day(rng.randrange(-600, 1200)) for _ in range(300)] + [None, day(0), day(0)]
    facts = spark.createDataFrame(list(enumerate(days)), "id int, d date")
    got = I.interval_join(facts, windows_of(spark, spans), "d", "lo", "hi", "id", limit=limit, salts=3)
    assert got.columns == ["id", "d", "w", "lo", "hi"]
    want = sorted((i, w) for i, d in enumerate(days) for w, (lo, hi) in enumerate(spans) if d and lo and hi and lo <= d <= hi)
    assert sorted((r["id"], r["w"]) for r in got.collect()) == want


def test_no_windows_no_rows(spark):
    facts = spark.createDataFrame([(1, day(3))], "id int, d date")
    for spans in ([], [(day(4), day(2))]):
        none = I.interval_join(facts, windows_of(spark, spans), "d", "lo", "hi", "id")
        assert none.count() == 0 and none.columns == ["id", "d", "w", "lo", "hi"]
    assert I.interval_join(facts.where("1=0"), windows_of(spark, [(day(1), day(9))]), "d", "lo", "hi", "id").count() == 0


def test_a_million_long_windows(spark):
    """1M incidents of 365 days: about 14 ranges each, and the fact is not shuffled on the date alone."""
    start = F.date_add(F.lit(day(9000)), (F.col("id") % 1500).cast("int"))
    windows = spark.range(1_000_000).select(F.col("id").alias("w"), start.alias("lo"), F.date_add(start, 364).alias("hi"))
    n, levels = I.range_extent(I.dyadic_ranges(windows, "lo", "hi"))
    assert n < 17 * 1_000_000 and max(levels) <= 8
    days = [8999, 9000, 9700, 10863, 10864]
    facts = spark.createDataFrame([(i, day(d)) for i, d in enumerate(days)], "id int, d date")
    joined = I.interval_join(facts, windows, "d", "lo", "hi", "id", salts=1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "SortMergeJoin" in plan and "hashpartitioning(level" in plan and "hashpartitioning(d#" not in plan
    count = {r["id"]: r["count"] for r in joined.groupBy("id").count().collect()}
    starts = [9000 + k % 1500 for k in range(1500)]
    want = {i: sum(1_000_000 // 1500 + (k < 1_000_000 % 1500) for k, s in enumerate(starts) if s <= d <= s + 364)
            for i, d in enumerate(days)}
    assert count == {i: n for i, n in want.items() if n}


def test_tagging_is_the_same_both_ways(spark, monkeypatch):
    cases = cases_frame(spark, [dict(case_id=f"C{i}", kpi_name="gmv", start=f"2024-0{1 + i % 6}-10", end=f"2024-0{2 + i % 6}-05", description="",
                                     cause="", injection=dict(type="t", channel="web")) for i in range(8)])
    fact = spark.createDataFrame([order(i, dt.date(2024, 1, 1) + dt.timedelta(days=i % 250), channel=("web", "app")[i % 2])
                                  for i in range(500)], FACT_SCHEMA)
    by_calendar = sorted(map(tuple, W.incident_tagging(fact, cases).collect()))
    assert by_calendar
    assert sorted(map(tuple, W.incident_tagging(fact, cases, limit=0).collect())) == by_calendar
    monkeypatch.setattr(I, "BROADCAST_RANGES", 0)
    assert sorted(map(tuple, W.incident_tagging(fact, cases, limit=0).collect())) == by_calendar
