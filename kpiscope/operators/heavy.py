"""Joins on keys that hold a large share of the fact (J1, J8): measured heavy keys, salted.

One aggregate over the join key finds the keys of many rows with a mergeable frequent-items summary
(``approx_top_k``: counters that tasks keep and merge, nothing sorted or shuffled but the counters).
Rows of a heavy key are spread over as many salts as the key has fair shares of the rows, and the other
side's row of that key is repeated once for each salt. All other keys keep one salt, so the other side
hardly grows. Whether a key is found heavy changes where its rows go, never the result.

A heavy key is one of more than ``HEAVY`` fair shares of a shuffle partition. At most ``MOST`` of them are
spread, the most frequent ones; the table of them is broadcast. With adaptive skew handling Spark splits such
partitions at run time, and the measuring pass is not needed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAVY = 0.5             # fair shares of a partition above which a key is spread
TRACKED = 10_000        # counters of the summary; a count is too high by 3.5 / TRACKED of all rows at most
MOST = 1_000            # heavy keys that are looked for, at most; the summary cannot tell more apart


def adaptive_skew(spark: SparkSession) -> bool:
    return all(spark.conf.get(f"spark.sql.adaptive.{k}", "true") == "true" for k in ("enabled", "skewJoin.enabled"))


def heavy_keys(facts: DataFrame, key: str, partitions: int, tracked: int = TRACKED, most: int = MOST) -> dict:
    """The keys of more than ``HEAVY`` / ``partitions`` of the rows, with their numbers of salts."""
    row = facts.where(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {min(most, tracked)}, {tracked})").alias("top")).first()
    fair = max(1.0, row["n"] / partitions)
    return {t["item"]: max(2, math.ceil(t["count"] / (HEAVY * fair))) for t in row["top"] or [] if t["count"] > HEAVY * fair}


def salted_join(facts: DataFrame, other: DataFrame, key: str, other_key: str, spread: str, how: str = "left",
                partitions: int | None = None, measured: DataFrame | None = None) -> DataFrame:
    """``facts`` joined to ``other`` on ``key`` = ``other_key``, inner or left, rows as a plain join gives them.

    ``spread`` is a column of the facts of many values. ``measured`` is a table with the facts' key column
    that the heavy keys are counted in, where the facts themselves are costly to compute. A null key meets nothing; left joins keep its rows,
    spread over all partitions.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a {how} join would repeat the other side's rows")
    spark = facts.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = heavy_keys(measured or facts, key, partitions)
    kind = facts.schema[key].dataType.simpleString()
    salts = F.broadcast(spark.createDataFrame(list(hot.items()), f"_hot {kind}, _salts int"))
    part = F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.when(F.col(key).isNull(), F.lit(partitions)), F.lit(1)))
    left = facts.join(salts, F.col(key) == F.col("_hot"), "left").withColumn("_salt", part.cast("int")).drop("_hot", "_salts")
    right = (other.join(salts, F.col(other_key) == F.col("_hot"), "left")
             .withColumn("_other_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts"))
    return left.join(right, (F.col(key) == F.col(other_key)) & (F.col("_salt") == F.col("_other_salt")), how).drop("_salt", "_other_salt")


def key_join(facts: DataFrame, other: DataFrame, key: str, other_key: str, spread: str, how: str = "left",
             salted: bool | None = None, measured: DataFrame | None = None) -> DataFrame:
    """A plain join where Spark splits skewed partitions itself, else a salted one; ``salted`` decides if given."""
    if salted is None:
        salted = not adaptive_skew(facts.sparkSession)
    if salted:
        return salted_join(facts, other, key, other_key, spread, how, measured=measured)
    return facts.join(other, F.col(key) == F.col(other_key), how)
