"""Batch investigation of every incident in one plan.

    cases -> V0 baselines -> window calendars
    fact -> daily cube (one scan, partial aggregation) -> prefix sums
    prefix sums x window ends -> slice contribution (A11/A12, W1-W3, W5, V2)
                     -> window comparison (A7), labelled window aggregates (A8/A9)
    labelled window aggregates -> log of their row counts (G4)
    -> evidence (V1, V9 passes) -> checks (V3) -> verdicts (V4, V5, V8)
    -> finding and conclusion (V6, V7)

The daily cube is the only fact-sized input; every branch below reads it, and
Spark reuses its exchange instead of rescanning the fact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.fixed import MAX_INVESTIGATION_SECONDS, TXT_PURPOSE_AGGREGATE, TXT_PURPOSE_BREAKDOWN
from kpiscope.operators import audit as AU
from kpiscope.operators import compare as C
from kpiscope.operators import decide as D
from kpiscope.operators import rollups as R
from kpiscope.operators.prefix import case_extent, prefix_cube
from kpiscope.operators.windows import with_baseline
from kpiscope.session import materialize
from kpiscope.sources.runner import case_seconds


@dataclass
class Investigation:
    slices: DataFrame
    dims: DataFrame          # per (incident, dimension) evidence inputs
    run_log: DataFrame
    evidence: DataFrame
    checks: DataFrame
    verdicts: DataFrame
    findings: DataFrame


def run_log(cube: DataFrame, cases: DataFrame, dims=("channel", "region")) -> DataFrame:
    """The labelled-window analyses of each incident (A8, and A9 by each of ``dims``) with the
    number of rows that their results have, counted from those results."""
    total = R.agg_by_time_window(cube, cases).groupBy("case_id").agg(F.count("*").alias("rows"))
    by_dim = R.agg_by_dim_window(cube, cases, dims, ranked=False).groupBy("case_id", "dimension").agg(F.count("*").alias("rows"))
    rows = total.select("case_id", F.lit("q_aggregate").alias("query_id"), "rows").unionByName(
        by_dim.select("case_id", F.concat(F.lit("q_by_"), "dimension").alias("query_id"), "rows"))
    kpi = F.col("kpi")
    planned = [F.struct(F.lit(1).alias("seq"), F.lit("q_aggregate").alias("query_id"),
                        F.format_string(TXT_PURPOSE_AGGREGATE, kpi).alias("purpose"))]
    planned += [F.struct(F.lit(i + 2).alias("seq"), F.lit(f"q_by_{d}").alias("query_id"),
                         F.format_string(TXT_PURPOSE_BREAKDOWN, kpi, F.lit(d)).alias("purpose")) for i, d in enumerate(dims)]
    request = AU.request_extract(cases.select("case_id", F.concat_ws(" ", "kpi_name", "description").alias("_req")), "_req")
    return (request.select("case_id", F.explode(F.array(*planned)).alias("q")).select("case_id", "q.*")
            .join(rows, ["case_id", "query_id"], "left")
            .select("case_id", "seq", "query_id", "purpose", F.lit(True).alias("success"),
                    F.coalesce("rows", F.lit(0)).cast("bigint").alias("row_count")))


def investigate(cube: DataFrame, cases: DataFrame, mode: str = "raw",
                auto_approve: bool = True, elapsed: DataFrame | None = None,
                materialized: bool = True, runs: DataFrame | None = None,
                max_seconds: float = MAX_INVESTIGATION_SECONDS) -> Investigation:
    """``materialized`` writes the prefix sums of the daily cube once to the shared
    checkpoint folder; every later branch reads that table and the ranked slices.

    ``runs`` (``runner.case_runs``) are the records of texts that were run for the incidents. They take
    the place of the built-in analyses in the log, so failures and run times reach the review triggers
    and the grades; ``max_seconds`` is an incident's time budget.
    """
    cube = prefix_cube(cube, case_extent(cases)[1])
    if materialized:
        cube = materialize(cube, "prefix_cube")
    slices = C.slice_compare(cube, cases, mode=mode)
    dims = D.per_dimension(slices)
    wc = C.window_compare(cube, cases, "order_total", "sum")
    log = run_log(cube, cases) if runs is None else runs.select("case_id", "seq", "query_id", "purpose", "success", "row_count")
    if runs is not None and elapsed is None:
        elapsed = case_seconds(runs)
    ev1 = D.evidence_pass(log, dims, cases, wc)
    counts = D.pass_counts(cases, log, dims, ev1, elapsed)
    evidence = (ev1.join(counts.select("case_id", "passes"), "case_id")
                   .withColumn("pass_no", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes"))))
                   .drop("passes"))
    checks = D.verification_checks(counts)
    verdict = D.verdicts(counts, checks, auto_approve, max_seconds)
    found = D.findings(verdict, C.best_driver(slices), evidence)
    return Investigation(slices, dims, log, evidence, checks, verdict, found)


def summary(inv: Investigation, cases: DataFrame) -> DataFrame:
    """One row per incident: windows, driver, checks, confidence, review."""
    c = with_baseline(cases).select("case_id", "affected_start_date", "affected_end_date",
                                    "baseline_start", "baseline_end")
    f = inv.findings
    return c.join(f, "case_id").select(
        "case_id", "kpi_name", "affected_start_date", "affected_end_date", "baseline_start",
        "baseline_end", F.col("dimension").alias("driver_dimension"),
        F.col("dimension_value").alias("driver_slice"),
        F.col("contribution_pct").alias("driver_contribution_pct"),
        F.col("percent_change").alias("driver_percent_change"),
        "checks_passed", "confidence", "needs_review",
        F.array_join("review_reasons", ",").alias("review_reasons"), "review_status", "passes",
        (F.col("n_support1") * F.col("passes")).alias("n_supporting"),
        "primary_finding", "conclusion")


def investigate_cases(spark, sf_dir: str, cases: DataFrame, mode: str = "raw",
                      auto_approve: bool = True) -> tuple[Investigation, DataFrame]:
    """Investigate an incident DataFrame (e.g. from ``load_cases``) end to end:
    the fact scan is limited to the incidents' date range, then ``investigate``.
    Returns the investigation and its one-row-per-incident summary."""
    from kpiscope.operators.compare import daily_cube
    from kpiscope.operators.windows import window_bounds_of
    from kpiscope.sources.binding import canonical_orders

    lo, hi = window_bounds_of(cases)
    cube = daily_cube(canonical_orders(spark, sf_dir), lo=lo, hi=hi)
    inv = investigate(cube, cases, mode=mode, auto_approve=auto_approve)
    return inv, summary(inv, cases)
