"""Shared building blocks for the registered jobs: fact, cube, incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.operators.compare import daily_cube, slice_compare
from kpiscope.sources.binding import canonical_orders
from kpiscope.sources.cases import anomaly_bounds, cases_frame, window_bounds


def fact(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The canonical orders; with column names, only those and the joins that they need."""
    return canonical_orders(spark, sf_dir, columns or None)


def fact_between(spark: SparkSession, sf_dir: str, lo, hi, *columns: str) -> DataFrame:
    """The fact restricted to literal date bounds (pushed into the scan)."""
    return fact(spark, sf_dir, *columns).where(F.col("order_date").between(F.lit(lo), F.lit(hi)))


def fact_in_anomaly_windows(spark: SparkSession, sf_dir: str, *columns: str, cases=None) -> DataFrame:
    lo, hi = anomaly_bounds(cases)
    return fact_between(spark, sf_dir, lo, hi, *columns)


def incidents(spark: SparkSession, cases=None) -> DataFrame:
    return cases_frame(spark, cases)


def cube(spark: SparkSession, sf_dir: str, cases=None) -> DataFrame:
    """Daily cube over the literal date range of all incident windows."""
    lo, hi = window_bounds(cases)
    return daily_cube(fact(spark, sf_dir), lo=lo, hi=hi)


def slices(spark: SparkSession, sf_dir: str, metric=None, agg=None, mode="raw",
           cases=None) -> DataFrame:
    return slice_compare(cube(spark, sf_dir, cases), incidents(spark, cases), metric, agg, mode)
