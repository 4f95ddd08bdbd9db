"""Sources and sinks: incident JSON, Markdown folder, catalog, guarded SQL."""

import json
import os
import tempfile

from kpiscope.operators.retrieval import section_chunks
from kpiscope.sources import sinks as SK
from kpiscope.sources.cases import load_cases
from kpiscope.sources.corpus import read_markdown_dir
from kpiscope.sources.tables import read_table


def test_load_cases_defaults(spark):
    d = tempfile.mkdtemp(prefix="kpiscope-cases-")
    p = os.path.join(d, "cases.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump([{"case_id": "A", "kpi_name": "gmv", "affected_start_date": "2025-03-10",
                    "affected_end_date": "2025-03-16", "description": "x",
                    "expected_primary_cause": "y", "recommended_dimensions": ["channel"]},
                   {"case_id": "B", "kpi_name": "aov", "affected_start_date": "2025-04-01",
                    "affected_end_date": "2025-04-02"}], f, indent=2)
    rows = {r["case_id"]: r for r in load_cases(spark, p).collect()}
    assert str(rows["A"]["affected_start_date"]) == "2025-03-10"
    assert rows["A"]["recommended_dimensions"] == ["channel"]
    assert rows["B"]["expected_secondary_factors"] == [] and rows["B"]["description"] == ""
    assert rows["B"]["should_trigger_human_review"] is False


def test_markdown_folder(spark):
    d = tempfile.mkdtemp(prefix="kpiscope-md-")
    for name, text in [("b.md", "# B\nbody b"), ("a.md", "intro\n## A1\nbody"), ("skip.txt", "# no")]:
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    docs = read_markdown_dir(spark, d)
    assert sorted(r["source"] for r in docs.collect()) == ["a.md", "b.md"]
    chunks = section_chunks(docs).orderBy("source", "section_no").collect()
    assert [(c["source"], c["section"]) for c in chunks] == [("a.md", "overview"), ("a.md", "A1"), ("b.md", "B")]
    assert read_markdown_dir(spark, os.path.join(d, "missing")).count() == 0


def test_missing_table_is_empty(spark):
    assert read_table(spark, "/nonexistent", "orders").count() == 0


def test_catalog_and_guarded_sql(spark, sf_small):
    from kpiscope.operators.views import register_views
    names = register_views(spark, sf_small)
    assert "daily_kpi_summary" in SK.list_tables(spark)
    cols = {(r["table_name"], r["column_name"]) for r in SK.catalog_columns(spark, names).collect()}
    assert ("daily_kpi_summary", "gmv") in cols
    df, errors, text = SK.run_sql(spark, "SELECT order_date, gmv FROM daily_kpi_summary")
    assert errors == [] and text.endswith("LIMIT 10000") and df.count() > 0
    df, errors, _ = SK.run_sql(spark, "DROP TABLE orders")
    assert df is None and errors
    df, errors, _ = SK.run_sql(spark, "SELECT no_such_column FROM daily_kpi_summary")
    assert df is None and errors


def test_materialized_tables_go_with_their_application(tmp_path):
    """A second application writes a table: it can be read while that runs, and is gone afterwards."""
    import subprocess
    import sys
    code = f"""
from kpiscope.session import build_session, materialize
spark = build_session("local[1]", extra={{"spark.checkpoint.dir": "{tmp_path}/ckpt", "spark.driver.memory": "1g"}})
a = materialize(spark.range(5), "five")
print(a.count(), len(a.inputFiles()))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[:1] == ["5"], out.stderr[-2000:]
    assert [p.name for p in (tmp_path / "ckpt" / "kpiscope-tables").iterdir()] == []
