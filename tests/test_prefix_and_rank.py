"""Prefix sums against a plain sum over days, and ranks without a window over a group."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import FACT_SCHEMA, order
from kpiscope.operators import compare as C
from kpiscope.operators import prefix as P
from kpiscope.operators import ranking as R
from kpiscope.operators import rollups as RU
from kpiscope.sources.cases import cases_frame

START = dt.date(2024, 11, 20)


def sparse_orders(seed, n=400, span=200):
    """Orders with whole months missing for most slices, null slices and null totals."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = START + dt.timedelta(days=int(span * rng.random() ** 2))
        rows.append(order(i, day, payment_type=rng.choice(["a", "b", None]), total=rng.choice([None, 0.01, 12.5, 99.99]),
                          channel=rng.choice(["web"] * 8 + ["rare"]), refunded=rng.random() < 0.3, cancelled=rng.random() < 0.2,
                          customer_type=rng.choice(["new", "returning", None])))
    return rows


def case(i, start, end, baseline=None):
    return dict(case_id=f"P-{i}", kpi_name="gmv", start=str(start), end=str(end), description="d", cause="c", baseline=baseline)


def cases_of(seed):
    rng = random.Random(seed)
    found = []
    for i in range(12):
        lo = START + dt.timedelta(days=rng.randint(-40, 220))
        hi = lo + dt.timedelta(days=rng.choice([0, 1, 6, 40, 300, -3]))
        start = lo + dt.timedelta(days=rng.randint(-60, 5))
        found.append(case(i, lo, hi, rng.choice([None, (str(start), str(start + dt.timedelta(days=rng.choice([0, 13, 75]))))])))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_lookups_equal_sums_over_days(spark, seed):
    cube = C.daily_cube(spark.createDataFrame(sparse_orders(seed), FACT_SCHEMA), ["payment_type", "channel"])
    cases = cases_frame(spark, cases_of(seed))
    days = cube.collect()
    for windows, label in ((P.comparison_windows(cases), "window"), (P.labelled_windows(cases), "time_window")):
        want = {}
        for w in windows.collect():
            for d in days:
                if w["lo"] <= d["order_date"] <= w["hi"]:
                    sums = want.setdefault((w["case_id"], w[label], d["dimension"], d["slice"]), [0] * len(P.MEASURE_COLUMNS))
                    for k, m in enumerate(P.MEASURE_COLUMNS):
                        sums[k] += d[m] or 0
        keys = ["case_id", label, "dimension", "slice"]
        got = (P.lookups(cube, windows, cases).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in P.MEASURE_COLUMNS])
               .where("n_rows > 0").collect())
        assert {tuple(r[k] for k in keys): [r[m] for m in P.MEASURE_COLUMNS] for r in got} == want and want


def test_labels_follow_the_day_calendar(spark):
    """The two ranges of an incident hold the same days as its labelled calendar."""
    from kpiscope.operators.windows import label_calendar
    cases = cases_frame(spark, cases_of(3) + cases_of(4))
    ranges = (P.labelled_windows(cases).where("lo <= hi")
              .select("case_id", "time_window", F.explode(F.sequence("lo", "hi")).alias("order_date")))
    key = lambda df: sorted((r["case_id"], r["order_date"], r["time_window"]) for r in df.collect())
    assert key(ranges) == key(label_calendar(cases))


def test_an_incident_costs_four_lookups_whatever_its_length(spark):
    cube = C.daily_cube(spark.createDataFrame(sparse_orders(5), FACT_SCHEMA), ["channel"])
    for length in (1, 180):
        cases = cases_frame(spark, [case(1, START + dt.timedelta(days=10), START + dt.timedelta(days=10 + length))])
        rows = P.lookups(cube, P.comparison_windows(cases), cases).groupBy("dimension", "slice").count().collect()
        assert rows and all(r["count"] <= 4 for r in rows)


def test_shuffled_window_ends_give_the_same(spark):
    cube = C.daily_cube(spark.createDataFrame(sparse_orders(6), FACT_SCHEMA), ["channel"])
    cases = cases_frame(spark, cases_of(6))
    both = [sorted(map(str, P.lookups(cube, P.comparison_windows(cases), cases, limit).collect())) for limit in (0, 10)]
    assert both[0] == both[1] and both[0]


def test_several_metrics_in_one_pass(spark):
    cube = C.daily_cube(spark.createDataFrame(sparse_orders(7), FACT_SCHEMA), ["channel"])
    cases = cases_frame(spark, cases_of(7))
    metrics = ["order_total", "is_refunded", "is_cancelled"]
    for agg in ("sum", "mean", "count"):
        together = C.window_compare(cube, cases, metrics, agg)
        assert together.count() == 12 * len(metrics)
        for m in metrics:
            one = C.window_compare(cube, cases, m, agg)
            assert sorted(map(str, one.collect())) == sorted(map(str, together.where(F.col("metric") == m).collect()))


def plain_rank(df, group, order_by):
    return df.withColumn("want", F.row_number().over(Window.partitionBy(*group).orderBy(*order_by)).cast("long"))


def test_rank_and_totals_equal_a_window(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("if(id % 11 = 0, null, id % 4) as g", "cast(hash(id) % 50 as long) as v", "id")
    order_by = [F.abs("v").desc(), F.col("id").asc()]
    got = R.with_rank(plain_rank(df, ["g"], order_by), ["g"], order_by, "r", {"total": F.col("v")}, "test")
    assert got.count() == 3000 and got.where("r <> want").count() == 0
    sums = {r["g"]: r["s"] for r in df.groupBy("g").agg(F.sum("v").alias("s")).collect()}
    assert {r["g"]: r["total"] for r in got.select("g", "total").distinct().collect()} == sums
    assert R.with_rank(df.where("1 = 0"), ["g"], order_by, "r").count() == 0


def test_a_dimension_of_a_million_slices_spreads(spark):
    """One group holds all rows; the ranks are 1..n and no partition holds much more than its share."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).selectExpr("'INC' as case_id", "'sku' as dimension", "cast(pmod(hash(id), 100000) as long) as chg", "id")
    order_by = [F.col("chg").desc(), F.col("id").asc()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = R.sorted_rows(df, ["case_id", "dimension"], order_by, "million")
        sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 2 * n / len(sizes)
        got = R.with_rank(df, ["case_id", "dimension"], order_by, "r", {"total": F.col("chg")}, "million")
        check = got.agg(F.min("r"), F.max("r"), F.count_distinct("r"), F.max("total"), F.sum("chg")).first()
        assert check[:3] == (1, n, n) and check[3] == check[4]
        # neighbours in rank are neighbours in order
        later = got.select((F.col("r") - 1).alias("r"), F.col("chg").alias("next_chg"), F.col("id").alias("next_id"))
        wrong = got.join(later, "r").where("next_chg > chg or (next_chg = chg and next_id < id)")
        assert wrong.count() == 0
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "row_number" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
