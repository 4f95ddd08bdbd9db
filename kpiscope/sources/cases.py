"""Incident (labelled case) input (S5); the default incidents are literals in ``kpiscope.incidents``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.functions.fixed import DEFAULT_BASELINE_DAYS
from kpiscope.incidents import DEFAULT_CASES

INJECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("payment_type", T.StringType()),
    T.StructField("campaign", T.StringType()),
    T.StructField("factor", T.DoubleType()),
    T.StructField("volume_factor", T.DoubleType()),
    T.StructField("price_factor", T.DoubleType()),
])

CASE_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType(), False),
    T.StructField("kpi_name", T.StringType(), False),
    T.StructField("affected_start_date", T.DateType(), False),
    T.StructField("affected_end_date", T.DateType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("expected_primary_cause", T.StringType()),
    T.StructField("expected_secondary_factors", T.ArrayType(T.StringType())),
    T.StructField("recommended_dimensions", T.ArrayType(T.StringType())),
    T.StructField("should_trigger_human_review", T.BooleanType()),
    T.StructField("baseline_start", T.DateType()),
    T.StructField("baseline_end", T.DateType()),
    T.StructField("injection", INJECTION),
])

_D = dt.date.fromisoformat


def case_rows(cases=None) -> list[dict]:
    rows = []
    for c in cases or DEFAULT_CASES:
        inj = dict.fromkeys(INJECTION.fieldNames())
        inj.update(c.get("tag") or c.get("injection") or {})
        bl = c.get("baseline") or (None, None)
        rows.append({
            "case_id": c["case_id"], "kpi_name": c["kpi_name"],
            "affected_start_date": _D(c["start"]), "affected_end_date": _D(c["end"]),
            "description": c["description"], "expected_primary_cause": c["cause"],
            "expected_secondary_factors": list(c.get("secondary") or []),
            "recommended_dimensions": list(c.get("dims") or []),
            "should_trigger_human_review": bool(c.get("review", False)),
            "baseline_start": _D(bl[0]) if bl[0] else None,
            "baseline_end": _D(bl[1]) if bl[1] else None,
            "injection": inj,
        })
    return rows


def _baseline(r: dict) -> tuple[dt.date, dt.date]:
    """V0 on the driver: both ends are replaced when either is missing."""
    if r["baseline_start"] is not None and r["baseline_end"] is not None:
        return r["baseline_start"], r["baseline_end"]
    start = r["affected_start_date"]
    days = max((r["affected_end_date"] - start).days + 1, DEFAULT_BASELINE_DAYS)
    return start - dt.timedelta(days=days), start - dt.timedelta(days=1)


def calendar_size(cases=None) -> int:
    """Rows that the larger day calendar (windows, or labelled days) of a driver-side list can have."""
    n = 0
    for r in case_rows(cases):
        start, end = r["affected_start_date"], r["affected_end_date"]
        lo, hi = _baseline(r)
        labelled = (end - lo).days + 1
        n += max(max(0, (hi - lo).days + 1) + max(0, (end - start).days + 1), labelled)
    return n


def cases_frame(spark: SparkSession, cases=None) -> DataFrame:
    """Incident table from a driver-side list; its calendar size is known
    exactly here, so the broadcast size check needs no job."""
    df = spark.createDataFrame(case_rows(cases), CASE_SCHEMA)
    df._calendar_rows = calendar_size(cases)
    return df


def window_bounds(cases=None) -> tuple[dt.date, dt.date]:
    """Literal min/max date over every baseline and anomaly window of a
    driver-side incident list, so the fact scan gets a pushed range filter."""
    lo, hi = [], []
    for r in case_rows(cases):
        first, last = _baseline(r)
        lo += [r["affected_start_date"], first]
        hi += [r["affected_end_date"], last]
    return min(lo), max(hi)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON array of incidents; ISO dates parsed, missing arrays -> []."""
    raw = (spark.read.schema(CASE_SCHEMA).option("multiLine", True)
           .option("dateFormat", "yyyy-MM-dd").json(path))
    empty = F.array().cast("array<string>")
    return raw.select(
        "case_id", "kpi_name", "affected_start_date", "affected_end_date",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("expected_primary_cause", F.lit("")).alias("expected_primary_cause"),
        F.coalesce("expected_secondary_factors", empty).alias("expected_secondary_factors"),
        F.coalesce("recommended_dimensions", empty).alias("recommended_dimensions"),
        F.coalesce("should_trigger_human_review", F.lit(False)).alias("should_trigger_human_review"),
        "baseline_start", "baseline_end", "injection")


KNOWN_IDS_SHOWN = 50


def select_cases(cases: DataFrame, ids: list[str]) -> DataFrame:
    """The incidents with the given ids; no ids mean all. An unknown id is an error that lists
    known ones (the first 50)."""
    if not ids:
        return cases
    wanted = cases.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "case_id string")
    unknown = [r["case_id"] for r in wanted.join(cases.select("case_id"), "case_id", "left_anti").orderBy("case_id").collect()]
    if unknown:
        known = [r["case_id"] for r in cases.select("case_id").orderBy("case_id").limit(KNOWN_IDS_SHOWN).collect()]
        raise ValueError(f"unknown incidents: {', '.join(unknown)}; known: {', '.join(known)}")
    return cases.join(wanted, "case_id", "left_semi")


def published_cases(cases: DataFrame) -> DataFrame:
    """The labelled incidents without the private injection spec."""
    return cases.drop("injection")


def anomaly_bounds(cases=None) -> tuple[dt.date, dt.date]:
    """Literal min start / max end over the anomaly windows of a driver-side list."""
    rows = case_rows(cases)
    return min(r["affected_start_date"] for r in rows), max(r["affected_end_date"] for r in rows)
