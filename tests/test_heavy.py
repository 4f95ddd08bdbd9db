"""Salted joins equal plain ones, and a hot key's rows are spread."""

import random

import pytest
from pyspark.sql import functions as F

from kpiscope.operators import heavy as H


@pytest.fixture
def plain_plans(spark):
    """No adaptive execution, no broadcast of measured sides."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def facts_of(spark, n):
    """A third of the rows on one key."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).cast("bigint").alias("k"))


def sizes(joined):
    rows = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return sorted(r["count"] for r in rows)


def test_largest_task_stays_near_the_median(spark, plain_plans):
    facts, other = facts_of(spark, 300_000), spark.range(5000).select(F.col("id").alias("ok"), F.lit("x").alias("v"))
    plain = sizes(facts.join(other, F.col("k") == F.col("ok"), "left"))
    spread = sizes(H.key_join(facts, other, "k", "ok", "id"))         # chosen, since nothing adaptive is on
    assert sum(spread) == sum(plain) == 300_000
    assert plain[-1] > 5 * plain[len(plain) // 2] and spread[-1] <= 3 * spread[len(spread) // 2]


def test_heavy_keys_are_the_frequent_ones(spark):
    got = H.heavy_keys(facts_of(spark, 30_000), "k", 16)
    assert set(got) == {7} and 8 <= got[7] <= 14
    assert H.heavy_keys(facts_of(spark, 0), "k", 16) == {}
    assert H.heavy_keys(spark.range(1000).withColumnRenamed("id", "k"), "k", 16) == {}


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_salted_join_equals_a_plain_join(spark, how, kind):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3, None, rng.randrange(40)]), f"t{i % 4}") for i in range(800)]
    facts = spark.createDataFrame(rows + rows[:20], "id int, k int, a string").withColumn("k", F.col("k").cast(kind))
    other = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (None, "s"), (30, "t"), (99, "u")], "ok int, b string")
    other = other.withColumn("ok", F.col("ok").cast(kind))
    got = H.salted_join(facts, other, "k", "ok", "id", how, partitions=8)
    want = facts.join(other, F.col("k") == F.col("ok"), how)
    assert got.columns == want.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert H.salted_join(facts.where("1=0"), other, "k", "ok", "id", how).count() == 0
    assert H.salted_join(facts, other.where("1=0"), "k", "ok", "id", how).count() == (0 if how == "inner" else 820)


def test_joins_that_would_repeat_rows_are_refused(spark):
    with pytest.raises(ValueError, match="full"):
        H.salted_join(facts_of(spark, 3), spark.range(3).toDF("ok"), "k", "ok", "id", "full")
