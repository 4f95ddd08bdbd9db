"""The daily cube as a stored table that is refreshed by part.

The fact lies in Parquet folders by ``part``, a day or a month of order_date. A refresh lists the fact's
files (names, sizes and times; no contents), compares each part's files with those that the stored cube
was made from, and recomputes the parts that differ: only their folders are read, and a dynamic
partition overwrite replaces only their folders of the cube. Parts whose files are gone are left out
by the reader, which takes the parts that the last refresh listed.

The state is written after the cube. A run that is lost in between recomputes the same parts again; one
that is lost while it writes the state leaves none, and the next run rebuilds everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.operators.compare import daily_cube
from kpiscope.sources.tables import path_exists

DAY, MONTH = "yyyy-MM-dd", "yyyy-MM"
NO_DATE = "none"        # the part of rows without a date


def part_of(day: Column, pattern: str = DAY) -> Column:
    return F.coalesce(F.date_format(day, pattern), F.lit(NO_DATE))


def write_fact(fact: DataFrame, path: str, pattern: str = DAY, mode: str = "overwrite") -> None:
    """Lay the fact out by part. Rows meet by part and a hash of the order, so a part of a third of all
    rows is written by several tasks. ``append`` adds files to parts that are there."""
    (fact.withColumn("part", part_of(F.col("order_date"), pattern))
     .repartition(F.col("part"), F.pmod(F.xxhash64("order_id"), F.lit(4)))
     .write.mode(mode).partitionBy("part").parquet(path))


def _with_part(schema: T.StructType) -> T.StructType:
    return T.StructType([*(f for f in schema if f.name != "part"), T.StructField("part", T.StringType())])


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table laid out by part; ``part`` is read as text, whatever it looks like."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], _with_part(schema))
    return spark.read.schema(_with_part(schema)).parquet(path)


def part_files(spark: SparkSession, path: str) -> DataFrame:
    """``part, n_files, files``: each part's number of files and a digest of their names, sizes and times."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "part string, n_files long, files long")
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
              .load(path).select("path", "length", "modificationTime"))
    return (listed.groupBy(F.regexp_extract("path", r"/part=([^/]+)/", 1).alias("part"))
            .agg(F.count(F.lit(1)).alias("n_files"),
                 F.bit_xor(F.xxhash64("path", "length", F.col("modificationTime").cast("long"))).alias("files")))


def stale_parts(spark: SparkSession, fact_path: str, cube_path: str) -> list[str]:
    """The parts whose files are not those that the stored cube was made from. Parts are days or months,
    so the list is bounded by the calendar and not by the fact."""
    now = part_files(spark, fact_path)
    state = f"{cube_path}-state"
    if path_exists(spark, state) and path_exists(spark, f"{state}/_SUCCESS"):
        now = now.join(spark.read.schema(now.schema).parquet(state), ["part", "n_files", "files"], "left_anti")
    return sorted(r["part"] for r in now.select("part").collect())


def stale_facts(spark: SparkSession, fact_path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
    """The fact rows of the given parts; the scan reads no other folder."""
    return read_parts(spark, fact_path, schema).where(F.col("part").isin(parts))


@dataclass
class Refreshed:
    cube: DataFrame
    parts: list[str]        # recomputed by this run


def refresh_cube(spark: SparkSession, fact_path: str, cube_path: str, schema: T.StructType,
                 pattern: str = DAY, dims=None) -> Refreshed:
    """Bring the stored cube up to the fact at ``fact_path`` (rows of ``schema``); returns it and what was
    recomputed. One refresh runs at a time. A fact that is not there or empty gives an empty cube."""
    listed = part_files(spark, fact_path).collect()
    parts = stale_parts(spark, fact_path, cube_path)
    facts = stale_facts(spark, fact_path, schema, parts)
    fresh = daily_cube(facts.drop("part"), dims)
    if parts:
        (fresh.withColumn("part", part_of(F.col("order_date"), pattern)).repartition("part")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(cube_path))
    state = spark.createDataFrame(listed, "part string, n_files long, files long").coalesce(1)
    state.write.mode("overwrite").parquet(f"{cube_path}-state")
    live = spark.read.schema(state.schema).parquet(f"{cube_path}-state").select("part")
    cube = read_parts(spark, cube_path, fresh.schema).join(F.broadcast(live), "part", "left_semi").drop("part")
    return Refreshed(cube, parts)
