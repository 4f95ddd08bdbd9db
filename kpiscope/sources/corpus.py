"""Markdown knowledge corpus (S6): one row per file, whole text, file name as source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.sources.tables import path_exists


def read_markdown_dir(spark: SparkSession, folder: str) -> DataFrame:
    """``(source, value)`` for every ``*.md`` file of ``folder`` (UTF-8, whole
    text). A missing folder yields an empty frame. Consumers order by
    ``source`` (file name) where order matters; no driver-side sort is done."""
    empty = spark.createDataFrame([], "source string, value string")
    if not path_exists(spark, folder):
        return empty
    df = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return df.select(F.col("_metadata.file_name").alias("source"), F.col("value"))
