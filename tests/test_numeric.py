"""Display texts against Python's own formatting."""

import random

import pytest

from kpiscope.functions.numeric import fmt_fixed


@pytest.mark.parametrize("digits, sign", [(1, False), (1, True), (2, False), (0, True)])
def test_fixed_digits_as_python_prints_them(spark, digits, sign):
    rng = random.Random(3)
    values = [k / 100 for k in range(-30_000, 30_001, 1)] + [k / 100 for k in range(5, 10_000_000, 9_990)]
    values += [rng.uniform(-1e6, 1e6) for _ in range(20_000)] + [0.25, 0.35, 0.05, 2.5, 3.5, 1e12 + 0.5, 778.35, 112.35, -0.04]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    spec = ("+" if sign else "") + f".{digits}f"
    for r in frame.select("v", fmt_fixed("v", digits, sign).alias("t")).collect():
        want = None if r["v"] is None or r["v"] != r["v"] else format(r["v"], spec)
        assert r["t"] == want, r["v"]


def test_no_python_in_registered_plans(spark, sf_small):
    from kpiscope.plans import catalog
    for key in ("investigate_all", "report_driver_rows", "chart_contribution_rows", "concentration_top1"):
        plan = catalog.QUERIES[key](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan, key
