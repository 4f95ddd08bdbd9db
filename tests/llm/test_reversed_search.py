import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from kpiscope.llm import reversed_search as R
from kpiscope.llm.queries import ORACLE, op12_reversed_search


def terms_of(text):
    lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_force(docs, items, k=10):
    """Every document against every item, in Python integers."""
    counts = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    counts = [(doc_id, c, sum(c.values())) for doc_id, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    want = {}
    merged = {}
    for item_id, text in items:
        merged.setdefault(item_id, set()).update(terms_of(text))
    for item_id, terms in merged.items():
        scored = []
        for doc_id, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        best = sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        want[item_id] = [(rank + 1, doc_id, -score) for rank, (score, _, doc_id) in enumerate(best)]
    return {i: w for i, w in want.items() if w}


def found(frame):
    got = {}
    for r in frame.orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return got


@pytest.mark.parametrize("index_bytes", [R.INDEX_BYTES, 20_000])
def test_table(spark, sf_small, index_bytes):
    docs, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(R.search(docs, items, index_bytes=index_bytes)) == want
    if index_bytes < R.INDEX_BYTES:
        assert len(list(R.item_blocks(items, index_bytes))) > 1


def test_sql(spark, sf_small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    rows = con.execute("SELECT item_id, rank, doc_id, score FROM (" + ORACLE["op12_reversed_search"] + ")").fetchall()
    got = op12_reversed_search(spark, sf_small).collect()
    assert sorted(rows) == sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) and rows


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "words plain"), (1, "words plain"), (2, None), (3, "..."), (4, "unknownterm"),
                                   (None, "alpha ünïcödé"), (5, "PLAIN text"), (6, "Ünïcödé")], "item_id long, text string")
    docs = odd_docs.unionByName(odd_docs.where("doc_id is null"))
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(R.search(docs, items)) == want
    assert [d for _, d, _ in want[1][:3]] == [1, 6, 6]
    assert R.search(no_docs, items).count() == 0 and R.search(docs, items.where("1 = 0")).count() == 0
    assert R.search(docs, items.where("item_id = 3")).count() == 0


def test_ties_and_many_tasks(spark):
    """Copies of one text by the hundred: the smallest ids win whatever task they are in."""
    docs = spark.range(0, 400, 1, 23).selectExpr("(id * 7919) % 400 as doc_id",
                                                 "if(id % 3 = 0, 'red fox runs', concat('blue sky ', id)) as text")
    items = spark.createDataFrame([(1, "fox"), (2, "sky blue")], "item_id long, text string")
    want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(R.search(docs, items)) == want


def test_large_counts_stay_integers():
    weight = R.weights(10 ** 12, np.array([0, 1, 10 ** 12]))
    assert weight.tolist() == [math.floor(1000 * math.log(2e12 + 2)), math.floor(1000 * math.log((2e12 + 2) / 3)),
                               math.floor(1000 * math.log((2e12 + 2) / (2e12 + 1)))]
