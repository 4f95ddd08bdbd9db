"""Window rules that once went wrong, and tables that are not there."""

import datetime as dt

import pytest
from helpers import FACT_SCHEMA, order

from kpiscope.operators import compare as C
from kpiscope.operators import rollups as R
from kpiscope.operators.windows import label_calendar, with_baseline
from kpiscope.session import ensure_checkpoint_dir
from kpiscope.sources.cases import cases_frame, window_bounds
from kpiscope.sources.corpus import read_markdown_dir
from kpiscope.sources.tables import path_exists, read_table


def case(cid, start, end, baseline=None, kpi="order_count"):
    return dict(case_id=cid, kpi_name=kpi, start=start, end=end, description="", cause="", baseline=baseline)


def orders(spark, *days, **kw):
    return spark.createDataFrame([order(i, dt.date.fromisoformat(d), **kw) for i, d in enumerate(days)], FACT_SCHEMA)


def test_half_given_baseline_is_replaced_on_both_sides(spark):
    half = [case("A", "2024-10-01", "2024-12-31", ("2024-09-15", None))]
    r = with_baseline(cases_frame(spark, half)).first()
    assert (r["baseline_start"], r["baseline_end"]) == (dt.date(2024, 7, 1), dt.date(2024, 9, 30))
    assert window_bounds(half) == (dt.date(2024, 7, 1), dt.date(2024, 12, 31))


def test_baseline_after_the_anomaly_has_no_labelled_days(spark):
    late = cases_frame(spark, [case("A", "2024-06-01", "2024-06-05", ("2024-06-10", "2024-06-20"))])
    assert label_calendar(late).count() == 0
    cube = C.daily_cube(orders(spark, "2024-06-01", "2024-06-12"))
    r = C.window_compare(cube, late, agg="count").first()
    assert r["baseline_days"] == 11 and r["anomaly_days"] == 5 and r["anomaly_daily"] == 0.2


def test_incident_without_orders_counts_as_zero(spark):
    cases = cases_frame(spark, [case("A", "2030-01-01", "2030-01-31"), case("B", "2024-06-01", "2024-06-05")])
    got = {r["case_id"]: r for r in C.window_compare(C.daily_cube(orders(spark, "2024-06-01")), cases).collect()}
    assert set(got) == {"A", "B"} and got["A"]["anomaly_daily"] == got["A"]["baseline_daily"] == got["A"]["percent_change"] == 0.0


def test_null_slice_is_a_group_of_breakdowns_only(spark):
    cases = cases_frame(spark, [case("A", "2024-06-01", "2024-06-05")])
    fact = orders(spark, "2024-06-01", "2024-06-02", channel=None).unionByName(orders(spark, "2024-06-03", channel="web"))
    cube = C.daily_cube(fact)
    by = {r["slice"]: r["order_count"] for r in R.agg_by_dim_window(cube, cases, ("channel",)).collect()}
    assert by == {None: 2, "web": 1}
    assert {r["dimension_value"] for r in C.slice_compare(cube, cases).where("dimension = 'channel'").collect()} == {"web"}


def test_missing_tables_are_asked_of_their_file_system(spark, tmp_path, sf_small):
    assert path_exists(spark, f"file://{sf_small}/orders.parquet") and not path_exists(spark, f"file://{tmp_path}/orders.parquet")
    assert read_table(spark, f"file://{tmp_path}", "orders").count() == 0
    assert read_table(spark, f"file://{sf_small}", "orders").count() > 0
    (tmp_path / "a.md").write_text("# x")
    assert read_markdown_dir(spark, f"file://{tmp_path}").count() == 1 and read_markdown_dir(spark, f"{tmp_path}/none").count() == 0


class _Cluster:
    """What ensure_checkpoint_dir asks of a session, on a master that is not local."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Cluster)


def test_case_selection(spark):
    from kpiscope.sources.cases import select_cases
    cases = cases_frame(spark)
    assert select_cases(cases, []).count() == cases.count()
    assert {r["case_id"] for r in select_cases(cases, ["INC-002", "INC-002"]).collect()} == {"INC-002"}
    with pytest.raises(ValueError, match="INC-404.*known: INC-001, INC-002"):
        select_cases(cases, ["INC-001", "INC-404"])


def test_refresh_replaces_and_counts(spark, tmp_path):
    from kpiscope.sources.sinks import full_refresh
    path = str(tmp_path / "t")
    assert full_refresh(spark.range(10), path)[1] == 10
    table, rows = full_refresh(spark.range(3), path, "id")
    assert rows == 3 and table.count() == 3


def test_case_without_a_verdict_is_an_all_miss_row(spark, sf_small):
    from kpiscope.operators import evaluate as EV
    from kpiscope.plans import catalog
    cases = cases_frame(spark, [case("INC-001", "1995-04-10", "1995-06-18"), case("LOST", "2024-06-01", "2024-06-05")])
    grades = catalog.QUERIES["grade_cases"](spark, sf_small).where("case_id = 'INC-001'")
    errors = spark.createDataFrame([("LOST", "e" * 300)], "case_id string, error string")
    got = {r["case_id"]: r for r in EV.with_failed(grades, cases, errors).collect()}
    assert set(got) == {"INC-001", "LOST"} and not got["LOST"]["primary_cause_hit"]
    assert got["LOST"]["predicted_cause_full"] == "ERROR: " + "e" * 300 and got["LOST"]["confidence"] == "inconclusive"
