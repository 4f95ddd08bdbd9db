"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied when this package builds the session itself (tests, bench).
# On a cluster the session comes from the platform and these are only
# suggestions: nothing here overrides a value that is already set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no per-call call-site capture (4 JVM round trips per Column function)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # local mode: the driver is the executor (applies only when this process
    # launches the JVM)
    "spark.driver.memory": "8g",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "kpiscope", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used as is. Only a local
    master may go without: a scratch folder of one machine is not seen by the
    executors of a cluster, whose tables would be read back incomplete.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="kpiscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: lineage is cut, the result survives executor loss, and later
    branches scan a small table instead of recomputing its inputs. The table
    goes when the application ends (a driver that is killed leaves it)."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/kpiscope-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each Spark application.

    Python workers do not see the driver's ``sys.path``. Where the package is installed, on the
    PYTHONPATH or was submitted as an archive, they have it; else its sources go out with
    ``addPyFile``.
    """
    import site
    import zipfile

    context = spark.sparkContext
    package = os.path.dirname(os.path.realpath(__file__))
    root = os.path.dirname(package)
    known = [os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()) if p]
    if root in known or not os.path.isdir(package) or getattr(context, "_kpiscope_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="kpiscope-code-"), "kpiscope.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._kpiscope_shipped = True
