"""Sinks (S3, S4, S7) and the guarded SQL entry point."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kpiscope.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kpiscope-out/{name}-{uuid.uuid4().hex}"


def full_refresh(df: DataFrame, path: str, sort_col: str | None = None) -> tuple[DataFrame, int]:
    """S3 + S4: replace the table at ``path``; returns it, reread, and the rows written.

    Rows are sorted within each output file by ``sort_col`` so Parquet min/max statistics let
    later range filters skip row groups. The count is observed while writing, without a job of its own.
    """
    written = Observation()
    out = (df.sortWithinPartitions(sort_col) if sort_col else df).observe(written, F.count(F.lit(1)).alias("rows"))
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), written.get["rows"]


def json_round_trip(df: DataFrame, path: str) -> DataFrame:
    """Write records as JSON lines (nested structs kept) and read them
    back with the writer's schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def run_sql(spark: SparkSession, sql: str) -> tuple[DataFrame | None, list[str], str]:
    """S11 behind G1: validate the text, then plan it with spark.sql (lazy).

    Returns (frame or None, errors, sanitized text). The sanitized text
    carries the row cap (O3) when the query had no LIMIT. Planning errors are
    returned as errors, not raised.
    """
    from kpiscope.operators.audit import validate

    v = validate(spark.createDataFrame([("q", sql)], "query_id string, sql string")).first()
    if not v["is_valid"]:
        return None, list(v["errors"]), v["sanitized_sql"]
    try:
        return spark.sql(v["sanitized_sql"]), [], v["sanitized_sql"]
    except Exception as e:  # noqa: BLE001 - any planning error becomes a failed run
        return None, [str(e).splitlines()[0]], v["sanitized_sql"]


def catalog_columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """Column names and types of registered tables / views."""
    rows = [(n, f.name, f.dataType.simpleString()) for n in names for f in spark.table(n).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def list_tables(spark: SparkSession) -> list[str]:
    """Names of the registered tables and views."""
    return sorted(t.name for t in spark.catalog.listTables())

