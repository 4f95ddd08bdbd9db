"""Parquet scans of the source tables with explicit schemas."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

log = logging.getLogger("kpiscope")

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                        ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                    ("p_size", I), ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                        ("l_linenumber", I), ("l_quantity", D), ("l_extendedprice", D),
                        ("l_discount", D), ("l_tax", D), ("l_returnflag", S),
                        ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                      ("value", D), ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "benchmark": _schema(("item_id", L), ("text", S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path's own file system (the session's default one for a plain path) has it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; a missing table yields an empty frame with its schema.

    Columns are pruned and filters pushed by Catalyst from the consumer's
    projection, so the full schema is declared here once.
    """
    schema = SCHEMAS[name]
    in_catalog = getattr(sf_dir, "tables", {}).get(name)       # a BucketedDir
    if in_catalog:
        return spark.table(in_catalog)
    path = table_path(sf_dir, name)
    if not path_exists(spark, path):
        log.warning("table %s not found at %s: using an empty table", name, path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)



def spread(df: DataFrame) -> DataFrame:
    """A scan whose file splits are fewer than the session's cores, dealt over them.

    For scans that feed heavy work on each row (regular expressions over texts). A table of many
    splits, as any large one, is returned as it is, without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
