"""Confidence ladder, review routing with reviewer decisions, published labels."""

from pyspark.sql import functions as F

from kpiscope.operators import decide as D
from kpiscope.sources.cases import cases_frame, published_cases


def test_confidence_ladder(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "p int")
    got = [r["c"] for r in df.select(D.confidence_of(F.col("p")).alias("c")).orderBy("p").collect()]
    assert got == ["inconclusive", "inconclusive", "low", "medium", "high", "high"]


def _counts(spark, rows):
    return spark.createDataFrame(rows, "case_id string, kpi_name string, n_sql bigint, n_sql_ok bigint, "
                                 "n_analyses bigint, any_concentrated boolean, n_support1 bigint, "
                                 "n_warn1 bigint, elapsed_seconds double, passes bigint")


def test_checks_triggers_and_routing(spark):
    counts = _counts(spark, [("ok", "gmv", 3, 3, 6, True, 10, 0, 0.0, 1),
                             ("weak", "gmv", 3, 1, 6, False, 8, 2, 130.0, 3)])
    checks = D.verification_checks(counts)
    v = {r["case_id"]: r for r in D.verdicts(counts, checks, auto_approve=False).collect()}
    assert v["ok"]["checks_passed"] == 5 and v["ok"]["confidence"] == "high"
    assert v["ok"]["review_status"] == "not_required" and not v["ok"]["needs_review"]
    w = v["weak"]
    assert w["checks_passed"] == 3 and w["confidence"] == "medium"
    assert list(w["review_reasons"]) == ["sql_validation_failure", "cost_exceeded", "weak_evidence"]
    assert w["review_status"] == "pending" and w["sql_failure_count"] == 6
    detail = {r["check_name"]: r["detail"] for r in checks.where("case_id = 'weak'").collect()}
    assert detail["supporting_evidence"] == "24 supporting evidence items"
    assert detail["sample_size_adequate"] == "6 sample size warnings"
    decisions = spark.createDataFrame([("weak", "Rejected"), ("ok", "rejected")], "case_id string, decision string")
    routed = D.apply_review_decisions(D.verdicts(counts, checks, auto_approve=False), decisions)
    r = {x["case_id"]: x["review_status"] for x in routed.collect()}
    assert r == {"ok": "not_required", "weak": "rejected"}     # only cases needing review are settled
    assert [x["case_id"] for x in D.reportable(routed).collect()] == ["ok"]


def test_published_cases_drop_injection(spark):
    assert "injection" not in published_cases(cases_frame(spark)).columns
