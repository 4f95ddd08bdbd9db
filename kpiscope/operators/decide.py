"""Evidence, verification and decisions for all incidents at once (V1-V9).

Everything here works on small per-incident tables derived from the
contribution job (a few rows per incident and dimension), so the only heavy
work in an investigation is the single fact scan behind the daily cube.

Retry passes (V9) are deterministic: a pass that is not fully supported is
repeated with its evidence carried over, at most ``MAX_RETRIES`` times. Only
the supporting-evidence count depends on the number of passes, so the pass
count is solved in closed form and the evidence table is replicated by pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.fixed import (CAVEAT_CORRELATION, CAVEAT_SMALL_SAMPLE, CHECK_NAMES,
                                      CONCENTRATION_PCT, DIMENSIONS, MAX_INVESTIGATION_SECONDS,
                                      MAX_RETRIES, MIN_SLICE_SAMPLE, MIN_SUPPORTING_EVIDENCE,
                                      TXT_ANALYSIS_EVIDENCE, TXT_BASELINE_EVIDENCE,
                                      TXT_CHECK_ANALYSES, TXT_CHECK_CONCENTRATED, TXT_CHECK_DIFFUSE,
                                      TXT_CHECK_SAMPLES_OK, TXT_CHECK_SQL, TXT_CHECK_SUPPORT,
                                      TXT_CHECK_WARNINGS, TXT_CONCLUSION, TXT_CONCLUSION_DIFFUSE,
                                      TXT_FINDING, TXT_SAMPLE_WARNING, TXT_SMALL_SAMPLE,
                                      TXT_SQL_EVIDENCE)
from kpiscope.functions.numeric import fmt_fixed, fmt_short, round2


def _dim_pos() -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))


def _yes_no(c: Column) -> Column:
    return F.when(c, F.lit("True")).otherwise(F.lit("False"))


EVIDENCE_COLS = ["case_id", "seq", "evidence_id", "source_type", "source_ref", "description",
                 "supports_conclusion", "strength"]


def sql_evidence(run_log: DataFrame) -> DataFrame:
    """One MEDIUM supporting row per successful analysis query."""
    return run_log.where("success").select(
        "case_id", F.col("seq").cast("bigint").alias("seq"),
        F.concat(F.lit("sql_"), F.col("query_id")).alias("evidence_id"),
        F.lit("sql_result").alias("source_type"), F.col("query_id").alias("source_ref"),
        F.format_string(TXT_SQL_EVIDENCE, F.col("purpose"), F.col("row_count"))
         .alias("description"),
        F.lit(True).alias("supports_conclusion"), F.lit("medium").alias("strength"))


def per_dimension(slices: DataFrame) -> DataFrame:
    """One row per (incident, dimension) with everything the evidence needs:
    slice count, the rank-1 driver, the A12 share of that driver, the largest
    |contribution| (the top-1 concentration test) and the small-slice flags in
    driver order. Numeric aggregates are hash-aggregated; the rank-1 driver's
    text comes from its own row (one per group), not from a string max."""
    small = (F.col("sample_size_anomaly") < MIN_SLICE_SAMPLE) | (F.col("sample_size_baseline") < MIN_SLICE_SAMPLE)
    flag = F.format_string(TXT_SMALL_SAMPLE, F.col("dimension_value"),
                           F.col("sample_size_baseline"), F.col("sample_size_anomaly"))
    g = slices.groupBy("case_id", "dimension").agg(
        F.count(F.lit(1)).alias("n_slices"),
        F.max(F.abs(F.col("contribution_pct"))).alias("max_abs_contribution"),
        F.sort_array(F.collect_list(F.when(small, F.struct("driver_rank", flag.alias("flag"))))).alias("flags"))
    top = slices.where(F.col("driver_rank") == 1).select(
        "case_id", "dimension", F.col("dimension_value").alias("top_slice"),
        F.col("contribution_pct").alias("top_contribution_pct"),
        F.col("percent_change").alias("top_percent_change"))
    return g.join(top, ["case_id", "dimension"]).withColumns({
        "concentrated": round2(F.abs(F.col("top_contribution_pct"))) > F.lit(CONCENTRATION_PCT),  # A12
        "conc_top1": F.col("max_abs_contribution") > F.lit(CONCENTRATION_PCT)})


def analysis_evidence(dims: DataFrame) -> DataFrame:
    """Per dimension: the top driver's text, HIGH when its top slice is concentrated."""
    desc = F.format_string(
        TXT_ANALYSIS_EVIDENCE, F.col("dimension"), F.col("top_slice"), fmt_fixed("top_contribution_pct", 1),
        fmt_fixed("top_percent_change", 1, sign=True), _yes_no(F.col("conc_top1")))
    return dims.select(
        "case_id", (F.lit(10) + F.lit(2) * _dim_pos()).cast("bigint").alias("seq"),
        F.concat(F.lit("analysis_"), F.col("dimension")).alias("evidence_id"),
        F.lit("analysis").alias("source_type"),
        F.concat(F.lit("contribution_"), F.col("dimension")).alias("source_ref"),
        desc.alias("description"), F.lit(True).alias("supports_conclusion"),
        F.when(F.col("conc_top1"), "high").otherwise("medium").alias("strength"))


def caveat_evidence(dims: DataFrame) -> DataFrame:
    """Per dimension with small slices: one non-supporting LOW row listing them."""
    return dims.where(F.size("flags") > 0).select(
        "case_id", (F.lit(11) + F.lit(2) * _dim_pos()).cast("bigint").alias("seq"),
        F.concat(F.lit("caveat_"), F.col("dimension"), F.lit("_sample_size")).alias("evidence_id"),
        F.lit("analysis").alias("source_type"),
        F.concat(F.lit("sample_check_"), F.col("dimension")).alias("source_ref"),
        F.format_string(TXT_SAMPLE_WARNING,
                        F.array_join(F.transform("flags", lambda x: x["flag"]), "; ")).alias("description"),
        F.lit(False).alias("supports_conclusion"), F.lit("low").alias("strength"))


def baseline_evidence(cases: DataFrame, wc_sum: DataFrame) -> DataFrame:
    """The whole-population order_total comparison, always present (zeros when empty)."""
    j = cases.select("case_id").join(wc_sum, "case_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    desc = F.format_string(TXT_BASELINE_EVIDENCE, fmt_short(z("baseline_daily")),
                           fmt_short(z("anomaly_daily")), fmt_fixed(z("percent_change"), 1, sign=True))
    return j.select("case_id", F.lit(100).cast("bigint").alias("seq"),
                    F.lit("baseline_comparison_order_total").alias("evidence_id"),
                    F.lit("analysis").alias("source_type"),
                    F.lit("baseline_comparison").alias("source_ref"), desc.alias("description"),
                    F.lit(True).alias("supports_conclusion"), F.lit("high").alias("strength"))


def evidence_pass(run_log, dims, cases, wc_sum) -> DataFrame:
    """All evidence of one pass (bag union, duplicates kept)."""
    return (sql_evidence(run_log).unionByName(analysis_evidence(dims))
            .unionByName(caveat_evidence(dims)).unionByName(baseline_evidence(cases, wc_sum)))


def pass_counts(cases: DataFrame, run_log: DataFrame, dims: DataFrame, ev1: DataFrame,
                elapsed: DataFrame | None = None) -> DataFrame:
    """Per incident: counts of one pass and the number of passes (V9).

    The four inputs are stacked as indicator rows and summed in one grouping
    (one shuffle instead of three aggregations and three joins)."""
    z, one = F.lit(0), F.lit(1)
    flag = lambda c: F.when(c, one).otherwise(z)
    cols = ["q", "q_ok", "an", "conc", "sup", "warn"]

    def rows(df, *vals):
        return df.select("case_id", *[v.alias(n) for v, n in zip(vals, cols)])

    stacked = (rows(run_log, one, flag(F.col("success")), z, z, z, z)
               .unionByName(rows(dims, z, z, one, flag(F.col("concentrated")), z, z))
               .unionByName(rows(ev1, z, z, z, z, flag(F.col("supports_conclusion")),
                                 flag(F.lower("description").contains("sample size")))))
    sums = stacked.groupBy("case_id").agg(
        F.sum("q").alias("n_sql"), F.sum("q_ok").alias("n_sql_ok"), F.sum("an").alias("n_analyses"),
        F.max("conc").alias("conc"), F.sum("sup").alias("n_support1"), F.sum("warn").alias("n_warn1"))
    c = cases.select("case_id", "kpi_name").join(sums, "case_id", "left")
    c = c.select("case_id", "kpi_name",
                 *[F.coalesce(F.col(n), z).cast("bigint").alias(n)
                   for n in ["n_sql", "n_sql_ok", "n_analyses", "n_support1", "n_warn1"]],
                 (F.coalesce(F.col("conc"), z) == 1).alias("any_concentrated"))
    if elapsed is not None:
        c = c.join(elapsed, "case_id", "left").withColumn(
            "elapsed_seconds", F.coalesce(F.col("elapsed_seconds"), F.lit(0.0)))
    else:
        c = c.withColumn("elapsed_seconds", F.lit(0.0))
    fixed_ok = ((F.col("n_sql_ok") > 0) & (F.col("n_analyses") > 0) & F.col("any_concentrated")
                & (F.col("n_warn1") == 0))
    ok_with = lambda k: fixed_ok & (F.col("n_support1") * k >= MIN_SUPPORTING_EVIDENCE)
    passes = F.lit(MAX_RETRIES + 1)
    for k in range(MAX_RETRIES, 0, -1):
        passes = F.when(ok_with(k), F.lit(k)).otherwise(passes)
    return c.withColumn("passes", passes.cast("bigint"))


def verification_checks(counts: DataFrame) -> DataFrame:
    """V3: the five checks after the final pass, one row per check."""
    k = F.col("passes")
    n_sup, n_warn = F.col("n_support1") * k, F.col("n_warn1") * k
    def chk(no, passed, detail):
        return F.struct(F.lit(no).alias("check_no"), F.lit(CHECK_NAMES[no - 1]).alias("check_name"),
                        passed.alias("passed"), detail.alias("detail"))
    checks = F.array(
        chk(1, F.col("n_sql_ok") > 0,
            F.format_string(TXT_CHECK_SQL, F.col("n_sql_ok"), F.col("n_sql"))),
        chk(2, F.col("n_analyses") > 0,
            F.format_string(TXT_CHECK_ANALYSES, F.col("n_analyses"))),
        chk(3, n_sup >= MIN_SUPPORTING_EVIDENCE,
            F.format_string(TXT_CHECK_SUPPORT, n_sup)),
        chk(4, F.col("any_concentrated"),
            F.when(F.col("any_concentrated"), F.lit(TXT_CHECK_CONCENTRATED))
             .otherwise(F.lit(TXT_CHECK_DIFFUSE))),
        chk(5, n_warn == 0,
            F.when(n_warn > 0, F.format_string(TXT_CHECK_WARNINGS, n_warn))
             .otherwise(F.lit(TXT_CHECK_SAMPLES_OK))))
    return (counts.select("case_id", F.explode(checks).alias("c"))
                  .select("case_id", F.col("c.check_no").cast("bigint").alias("check_no"),
                          "c.check_name", "c.passed", "c.detail"))


def confidence_of(passed: Column) -> Column:
    """V4: >=4 high, 3 medium, 2 low, else inconclusive."""
    return (F.when(passed >= 4, "high").when(passed >= 3, "medium")
             .when(passed >= 2, "low").otherwise("inconclusive"))


def verdicts(counts: DataFrame, checks: DataFrame, auto_approve: bool = True,
             max_seconds: float = MAX_INVESTIGATION_SECONDS) -> DataFrame:
    """V4 + V5 + V8: confidence, review triggers, review status per incident."""
    p = checks.groupBy("case_id").agg(F.count_if("passed").alias("checks_passed"),
                                      F.count(F.lit(1)).alias("checks_total"))
    v = counts.join(p, "case_id")
    conf = confidence_of(F.col("checks_passed"))
    fails = (F.col("n_sql") - F.col("n_sql_ok")) * F.col("passes")
    reasons = F.filter(F.array(
        F.when(conf.isin("low", "inconclusive"), F.lit("low_confidence")),
        F.when(fails >= 2, F.lit("sql_validation_failure")),
        F.when(F.col("elapsed_seconds") > max_seconds, F.lit("cost_exceeded")),
        F.when(F.col("checks_passed") < F.col("checks_total"), F.lit("weak_evidence"))),
        lambda r: r.isNotNull())
    needs = F.size(reasons) > 0
    status = F.when(~needs, "not_required").otherwise("approved" if auto_approve else "pending")
    return v.withColumns({"confidence": conf,
                          "overall_supported": F.col("checks_passed") == F.col("checks_total"),
                          "sql_failure_count": fails.cast("bigint"),
                          "review_reasons": reasons, "needs_review": needs, "review_status": status})


def findings(verdict: DataFrame, best: DataFrame, evidence: DataFrame) -> DataFrame:
    """V6 + V7: primary finding (when a driver exists) and the conclusion."""
    sup = (evidence.where("supports_conclusion")
                   .groupBy("case_id")
                   .agg(F.slice(F.sort_array(F.collect_list(F.struct("pass_no", "seq", "evidence_id"))),
                                1, 5).alias("_top")))
    j = verdict.join(best, "case_id", "left").join(sup, "case_id", "left")
    has = F.col("dimension").isNotNull()
    pct, contrib = fmt_fixed("percent_change", 1, sign=True), fmt_fixed("contribution_pct", 1)
    finding = F.when(has, F.format_string(
        TXT_FINDING, F.col("kpi_name"), F.col("dimension_value"), F.col("dimension"), pct, contrib))
    conclusion = F.when(has, F.format_string(
        TXT_CONCLUSION, F.col("kpi_name"), F.col("dimension_value"), F.col("dimension"), contrib,
        F.col("confidence"))).otherwise(F.format_string(TXT_CONCLUSION_DIFFUSE, F.col("kpi_name")))
    caveats = F.when(F.col("n_warn1") > 0, F.array(F.lit(CAVEAT_CORRELATION), F.lit(CAVEAT_SMALL_SAMPLE))) \
               .otherwise(F.array(F.lit(CAVEAT_CORRELATION)))
    ids = F.coalesce(F.transform("_top", lambda x: x["evidence_id"]), F.array().cast("array<string>"))
    return j.select(
        "*", finding.alias("primary_finding"), conclusion.alias("conclusion"),
        F.when(has, ids).alias("finding_evidence_ids"), F.when(has, caveats).alias("finding_caveats"))


def apply_review_decisions(verdict: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """V8 with a reviewer's input: ``decisions`` (case_id, decision) with
    decision 'approved' or 'rejected' settles cases that need review; cases
    without a decision keep their status (pending or auto-approved)."""
    if decisions is None:
        return verdict
    d = decisions.select("case_id", F.lower("decision").alias("_decision"))
    j = verdict.join(d, "case_id", "left")
    settled = F.col("needs_review") & F.col("_decision").isin("approved", "rejected")
    return j.withColumn("review_status", F.when(settled, F.col("_decision"))
                        .otherwise(F.col("review_status"))).drop("_decision")


def reportable(verdict: DataFrame) -> DataFrame:
    """A rejected case leaves the flow without a report."""
    return verdict.where(F.col("review_status") != "rejected")
