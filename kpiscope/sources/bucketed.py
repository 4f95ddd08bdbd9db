"""Bucketed layout of orders and lineitem.

Both tables are written bucketed and sorted by order key with the same number of buckets, one file a
bucket, so the roll-up of lines by order and every join on the order key read matching buckets and need
no exchange. ``BucketedDir`` stands for the folder of source tables wherever one is asked for: the
tables that were laid out are scanned by bucket, the others as they are.

A layout pays where several jobs read it: writing it costs one shuffle of each table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from kpiscope.sources.sinks import scratch_path
from kpiscope.sources.tables import read_table

BUCKET_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


class BucketedDir(str):
    """A folder of source tables, some of which are catalog tables in buckets."""

    tables: dict[str, str]

    def __new__(cls, sf_dir: str, tables: dict[str, str]) -> BucketedDir:
        out = super().__new__(cls, sf_dir)
        out.tables = tables
        return out

    def drop(self, spark: SparkSession) -> None:
        """Forget the catalog tables; their files stay in the checkpoint folder."""
        for table in self.tables.values():
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def lay_out(spark: SparkSession, sf_dir: str, buckets: int, name: str | None = None) -> BucketedDir:
    """Write orders and lineitem in ``buckets`` buckets to the shared checkpoint folder and enter them in
    the catalog as ``<name>_orders`` and ``<name>_lineitem``; a missing table is laid out empty.

    Choose ``buckets`` so that a bucket of lineitem is about 128-256 MB. Rows of one order lie in one
    bucket: order keys are near unique, so no bucket is hot.
    """
    name = name or f"kpiscope_{uuid.uuid4().hex}"
    tables = {}
    for table, key in BUCKET_KEYS.items():
        tables[table] = f"{name}_{table}"
        (read_table(spark, sf_dir, table).repartition(buckets, key)
         .write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
         .option("path", scratch_path(spark, tables[table])).saveAsTable(tables[table]))
    return BucketedDir(sf_dir, tables)
