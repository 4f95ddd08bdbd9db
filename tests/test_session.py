"""Intermediate tables go to the session's shared checkpoint folder."""

from pyspark.sql import functions as F

from kpiscope.session import ensure_checkpoint_dir, materialize


def test_materialize_writes_under_checkpoint_dir(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert base and ensure_checkpoint_dir(spark) == base          # read from the session, not replaced
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2), "unit")
    files = {r["f"] for r in df.select(F.input_file_name().alias("f")).collect()}
    assert files and all(base.rstrip("/") in f for f in files)
    assert df.agg(F.sum("x")).first()[0] == 90


def test_workers_get_the_package_without_a_path(tmp_path):
    """A session started elsewhere, without PYTHONPATH, can unpickle functions of this package."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    probe = """
import sys; sys.path.insert(0, %r)
from kpiscope.session import build_session, ship_package
spark = build_session("local[1]", 1)
ship_package(spark); ship_package(spark)

def run(frames):
    import kpiscope.functions.fixed as fixed
    for f in frames:
        yield f.assign(id=len(fixed.DIMENSIONS))

print("GOT", spark.range(1).mapInPandas(run, "id long").first()[0])
""" % root
    (tmp_path / "probe.py").write_text(probe)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "probe.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "GOT 6" in out.stdout, out.stderr[-800:]
