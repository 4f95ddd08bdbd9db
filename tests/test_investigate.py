"""End-to-end investigation of incidents loaded from a JSON file."""

import json
import os
import tempfile

import __spark_entry__ as E
from helpers import digest
from kpiscope.plans.investigate import investigate_cases
from kpiscope.sources.cases import DEFAULT_CASES, case_rows, load_cases


def test_json_incidents_match_builtin_list(spark, sf_small):
    rows = case_rows(DEFAULT_CASES)
    payload = []
    for r in rows:
        d = {k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in r.items()}
        payload.append(d)
    path = os.path.join(tempfile.mkdtemp(prefix="kpiscope-inc-"), "cases.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2)
    cases = load_cases(spark, path)
    _, summary = investigate_cases(spark, sf_small, cases)
    expected = E.queries()["investigate_all"](spark, sf_small)
    got = summary.select(*expected.columns)
    a = [tuple(r) for r in got.collect()]
    b = [tuple(r) for r in expected.collect()]
    assert len(a) == len(rows)
    assert digest(got.columns, a)[0] == digest(expected.columns, b)[0]
