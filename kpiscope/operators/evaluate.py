"""Grading investigations against labelled incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.functions.fixed import CAUSE_HIT_THRESHOLD, MIN_SUPPORTING_EVIDENCE, STOP_WORDS, SUFFIXES

SUFFIX_RE = "^(.{3,}?)(" + "|".join(SUFFIXES) + ")$"


def cause_tokens(text: Column) -> Column:
    """Lower-case, '_' and '-' as blanks, [a-z]+ words, drop words of at
    most two letters and stop words, strip the first matching suffix when at
    least three letters remain, as a sorted set.

    The suffix list is ordered so that no earlier suffix is a suffix of a later
    one, so the shortest-prefix regex picks exactly the first listed suffix
    that leaves three letters.
    """
    t = F.regexp_replace(F.lower(text), "[_-]", " ")
    words = F.array_distinct(F.regexp_extract_all(t, F.lit("[a-z]+"), 0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    stemmed = F.transform(kept, lambda w: F.regexp_replace(w, SUFFIX_RE, "$1"))
    return F.array_sort(F.array_distinct(stemmed))


def hit_ratio(pred: Column, expected: Column) -> Column:
    """|pred ∩ expected| / |expected| (NULL when expected is empty)."""
    inter = F.size(F.array_intersect(pred, expected))
    return F.when(F.size(expected) > 0, inter.cast("double") / F.size(expected).cast("double"))


def cause_hit(pred_text: Column, expected_text: Column) -> Column:
    """At least a quarter of the expected cause's words are predicted."""
    r = hit_ratio(cause_tokens(pred_text), cause_tokens(expected_text))
    return F.coalesce(r >= F.lit(CAUSE_HIT_THRESHOLD), F.lit(False))


def grade_cases(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """One grade per incident from its finding, conclusion and checks.

    ``findings`` is the investigation's per-incident table (verdict columns,
    primary_finding, conclusion); ``cases`` carries the expected cause.
    """
    j = findings.join(cases.select("case_id", "expected_primary_cause"), "case_id")
    exp = F.col("expected_primary_cause")
    finding_hit = F.col("primary_finding").isNotNull() & cause_hit(F.col("primary_finding"), exp)
    concl_hit = cause_hit(F.coalesce(F.col("conclusion"), F.lit("")), exp)
    primary = finding_hit | concl_hit
    full = F.when(F.col("primary_finding").isNotNull(), F.col("primary_finding")) \
            .when(concl_hit, F.col("conclusion")).otherwise(F.lit(""))
    predicted = F.when(F.col("primary_finding").isNotNull(), full).otherwise(F.substring(full, 1, 200))
    n_sup = F.col("n_support1") * F.col("passes")
    return j.select(
        "case_id",
        primary.alias("primary_cause_hit"),
        primary.alias("top_k_hit"),
        F.when(F.col("n_sql") > 0, F.col("n_sql_ok").cast("double") / F.col("n_sql").cast("double"))
         .otherwise(F.lit(0.0)).alias("sql_success_rate"),
        (n_sup >= MIN_SUPPORTING_EVIDENCE).alias("evidence_sufficient"),
        F.lit(0).cast("bigint").alias("unsupported_claim_count"),
        (F.col("review_status") != "not_required").alias("human_review_triggered"),
        F.col("elapsed_seconds").alias("runtime_seconds"),
        F.substring(predicted, 1, 500).alias("predicted_primary_cause"), full.alias("predicted_cause_full"),
        "confidence")


def with_failed(grades: DataFrame, cases: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The grades, and an all-miss row for every incident without one. ``errors`` (case_id, error)
    says why where it is known."""
    every = cases.select("case_id").join(grades.withColumn("_graded", F.lit(True)), "case_id", "left")
    every = every.withColumn("error", F.lit(None).cast("string")) if errors is None \
        else every.join(errors.select("case_id", "error"), "case_id", "left")
    failed = failed_case_grade(F.col("case_id"), F.coalesce("error", F.lit("no verdict")))
    return every.select(*[F.when(F.col("_graded"), F.col(n)).otherwise(c).alias(n) for n, c in zip(grades.columns, failed)])


def eval_summary(grades: DataFrame) -> DataFrame:
    """Means over the graded incidents (0 when there are none)."""
    avg = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return grades.agg(
        F.count(F.lit(1)).alias("total_cases"),
        avg("primary_cause_hit").alias("primary_hit_rate"),
        avg("top_k_hit").alias("top_k_hit_rate"),
        avg("sql_success_rate").alias("avg_sql_success_rate"),
        avg("evidence_sufficient").alias("evidence_sufficiency_rate"),
        avg("unsupported_claim_count").alias("avg_unsupported_claims"),
        avg("human_review_triggered").alias("human_review_trigger_rate"),
        avg("runtime_seconds").alias("avg_runtime_seconds"))


def per_case_rows(grades: DataFrame, cases: DataFrame) -> DataFrame:
    """E3 detail rows with the KPI looked up by id, '?' when unknown."""
    c = cases.select("case_id", "kpi_name")
    return (grades.join(c, "case_id", "left")
                  .select("case_id", F.coalesce("kpi_name", F.lit("?")).alias("kpi"),
                          F.when(F.col("primary_cause_hit"), "Y").otherwise("N").alias("primary_hit"),
                          "sql_success_rate",
                          F.when(F.col("evidence_sufficient"), "Y").otherwise("N").alias("evidence"),
                          "confidence", "runtime_seconds"))


def failed_case_grade(case_id: Column, error: Column) -> list[Column]:
    """A case whose investigation failed grades as an all-miss row."""
    return [case_id.alias("case_id"), F.lit(False).alias("primary_cause_hit"),
            F.lit(False).alias("top_k_hit"), F.lit(0.0).alias("sql_success_rate"),
            F.lit(False).alias("evidence_sufficient"),
            F.lit(0).cast("bigint").alias("unsupported_claim_count"),
            F.lit(False).alias("human_review_triggered"), F.lit(0.0).alias("runtime_seconds"),
            F.concat(F.lit("ERROR: "), F.substring(error, 1, 200)).alias("predicted_primary_cause"),
            F.concat(F.lit("ERROR: "), error).alias("predicted_cause_full"),
            F.lit("inconclusive").alias("confidence")]
