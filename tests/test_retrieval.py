"""Markdown chunking and BM25 ranking, checked against a brute-force scorer."""

import math
import re

from pyspark.sql import functions as F

from kpiscope.operators import retrieval as RT

METRICS = """# Metric Definitions

## GMV
Gross merchandise value (GMV) is the sum of order totals of paid orders.
GMV definition excludes cancelled and pending orders.

## Refund Rate
Refund rate calculation: refunded orders divided by all orders.
#### Note
This heading does not split.
"""
RULES = """Intro text before any heading.
# Business Rules
## Payment
A payment gateway outage can block credit card transactions.
## Campaign Calendar
Black Friday runs November 20-30; the campaign calendar lists every campaign.
## Empty
"""


def corpus(spark):
    docs = spark.createDataFrame([("business_rules.md", RULES), ("metric_definitions.md", METRICS)],
                                 "source string, value string")
    return RT.section_chunks(docs)


def test_chunker(spark):
    rows = [(r["source"], r["section"], r["content"]) for r in corpus(spark).orderBy("source", "section_no").collect()]
    sections = [(s, sec) for s, sec, _ in rows]
    assert sections == [("business_rules.md", "overview"), ("business_rules.md", "Business Rules"),
                        ("business_rules.md", "Payment"), ("business_rules.md", "Campaign Calendar"),
                        ("business_rules.md", "Empty"), ("metric_definitions.md", "Metric Definitions"),
                        ("metric_definitions.md", "GMV"), ("metric_definitions.md", "Refund Rate")]
    refund = [c for s, sec, c in rows if sec == "Refund Rate"][0]
    assert refund.startswith("## Refund Rate") and refund.endswith("This heading does not split.")
    assert [c for s, sec, c in rows if sec == "overview"] == ["Intro text before any heading."]


def _tok(text):
    return [t for t in re.sub(r"[^a-z0-9_\s]", " ", text.lower()).split() if len(t) > 1]


def brute_force(chunks, query, k1=1.5, b=0.75, eps=0.25):
    docs = [_tok(c) for c in chunks]
    n = len(docs)
    avgdl = sum(map(len, docs)) / n
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {t: (floor if v < 0 else v) for t, v in idf.items()}
    scores = [0.0] * n
    for q in _tok(query):
        for i, d in enumerate(docs):
            tf = d.count(q)
            scores[i] += idf.get(q, 0) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avgdl)))
    return scores


QUERIES = [("q1", "GMV definition"), ("q2", "refund rate calculation"),
           ("q3", "payment gateway outage credit card"), ("q4", "campaign calendar black friday"),
           ("q5", ""), ("q6", "gmv gmv refund")]


def test_bm25_matches_brute_force_and_expectations(spark):
    ch = corpus(spark).orderBy("source", "section_no")
    ix = RT.BM25Index(ch, materialized=False)
    q = spark.createDataFrame(QUERIES, "query_id string, text string")
    got = {(r["query_id"], r["source"], r["section_no"]): r["score"] for r in ix.scores(q).collect()}
    local = ch.collect()
    for qid, text in QUERIES:
        expect = brute_force([r["content"] for r in local], text)
        for r, e in zip(local, expect):
            g = got.get((qid, r["source"], r["section_no"]), 0.0)
            assert abs(g - e) < 1e-6, (qid, r["section"], g, e)
    top = ix.top_k(q, 3).collect()
    by_q = {}
    for r in top:
        by_q.setdefault(r["query_id"], []).append(r)
    assert "q5" not in by_q                                    # empty query -> no rows
    assert all(len(v) <= 3 for v in by_q.values())
    for v in by_q.values():
        scores = [r["relevance_score"] for r in sorted(v, key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True) and all(s > 0 for s in scores)
    first = {qid: [r["section"] for r in sorted(v, key=lambda r: r["rank"])] for qid, v in by_q.items()}
    assert "GMV" in first["q1"]
    assert first["q2"][0] == "Refund Rate"
    assert first["q3"][0] == "Payment"
    assert first["q4"][0] == "Campaign Calendar"


def test_exact_duplicates_tie_and_keep_corpus_order(spark):
    docs = spark.createDataFrame([(2, "alpha beta"), (1, "alpha beta"), (3, "gamma delta"),
                                  (4, "epsilon zeta"), (5, "eta theta"), (6, "iota kappa")],
                                 "doc_id long, text string")
    ix = RT.BM25Index(RT.documents_as_chunks(docs), materialized=False)
    q = spark.createDataFrame([("q", "beta")], "query_id string, text string")
    r = ix.top_k(q, 5).orderBy("rank").collect()
    assert [x["source"] for x in r] == [1, 2]
    assert r[0]["relevance_score"] == r[1]["relevance_score"]


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, World! a_b c Ünïcode x2",)], "t string")
    assert df.select(RT.tokens(F.col("t")).alias("k")).first()["k"] == ["hello", "world", "a_b", "code", "x2"]


def exhaustive_top(ix, q, k):
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ix.keys)
    s = ix.scores(q).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > 0))
    return sorted((r["query_id"], r["rank"], r["source"], r["section_no"]) for r in s.collect())


def ranked(top):
    return sorted((r["query_id"], r["rank"], r["source"], r["section_no"]) for r in top.collect())


def test_pruned_top_k_equals_scoring_every_pair(spark, sf_small):
    docs, items = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "benchmark"))
    ix = RT.BM25Index(RT.documents_as_chunks(docs))
    q = items.select(F.col("item_id").cast("string").alias("query_id"), "text").unionByName(
        spark.createDataFrame([("long", " ".join(r["text"] for r in items.limit(8).collect())), ("none", "zzzz qqqq"),
                               ("common", "the and of")], "query_id string, text string"))
    for k in (1, 5, 1000):
        assert ranked(ix.top_k(q, k, prune_from=0)) == ranked(ix.top_k(q, k)) == exhaustive_top(ix, q, k)


def test_pruning_touches_fewer_pairs(spark, sf_small):
    """Rows met by the pruned search against the pairs that the full scoring lists, for each query set."""
    from kpiscope.plans import base as B
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    ix = RT.BM25Index(RT.documents_as_chunks(docs))
    benchmark = spark.read.parquet(f"{sf_small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    cases = B.incidents(spark).select(F.col("case_id").alias("query_id"), F.concat_ws(" ", "kpi_name", "description").alias("text"))
    for q in (benchmark, cases):
        side, _ = ix._query_side(q, "query_id", "text")
        every = ix.tf.join(side.select("query_id", "term"), "term").count()
        found = ix.pruned(q)
        touched = found.essential.count() + found.lookups.count()
        assert touched < every, (touched, every)
        assert found.survivors.count() <= ix.scores(q).count()


def test_pruning_with_ties_at_the_floor_and_tiny_corpora(spark):
    rows = [(i, "alpha beta gamma" if i % 3 else "alpha beta delta epsilon") for i in range(40)]
    rows += [(100 + i, f"word{i} filler{i % 7} thing{i % 5}") for i in range(60)]
    q = spark.createDataFrame([("a", "alpha gamma filler3"), ("b", "delta delta alpha"), ("c", "thing1 word1 beta"), ("d", "")],
                              "query_id string, text string")
    for corpus_rows in (rows, rows[:2], rows[:1], []):
        ix = RT.BM25Index(RT.documents_as_chunks(spark.createDataFrame(corpus_rows, "doc_id long, text string")))
        assert ranked(ix.top_k(q, 5, prune_from=0)) == ranked(ix.top_k(q, 5)) == exhaustive_top(ix, q, 5)


def test_terms_are_counted_in_the_row_without_a_shuffle(spark):
    from collections import Counter
    texts = ["b a b a b", "", "-- !", "x", None, "one", " ".join(f"w{i % 700}" for i in range(60_000))]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "source int, content string, section string")
    post = RT.postings(df.withColumn("section_no", F.lit(0)))
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    for r in post.collect():
        want = _tok(texts[r["source"]] or "")
        got = {t["term"]: t["tf"] for t in r["terms"] or []}
        assert got == dict(Counter(want)) and len(got) == len(r["terms"] or []) and (texts[r["source"]] is None or r["dl"] == len(want))


def test_the_cost_rule_picks_the_pruned_search(spark, sf_small, monkeypatch):
    ix = RT.BM25Index(RT.documents_as_chunks(spark.read.parquet(f"{sf_small}/documents.parquet")))
    q = spark.read.parquet(f"{sf_small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(5)
    pairs = ix.tf.join(ix._query_side(q, "query_id", "text")[0], "term").count()
    calls = []
    pruned = RT.BM25Index._pruned
    monkeypatch.setattr(RT.BM25Index, "_pruned", lambda self, *a: calls.append(a) or pruned(self, *a))
    ix.top_k(q, prune_from=pairs + 1)
    assert not calls
    ix.top_k(q, prune_from=pairs)
    assert len(calls) == 1


def test_pairs_are_summed_in_the_task_of_their_chunk(spark, sf_small):
    """Postings are dealt out by chunk before they meet the queries; (query, chunk) pairs are not shuffled."""
    ix = RT.BM25Index(RT.documents_as_chunks(spark.read.parquet(f"{sf_small}/documents.parquet")))
    q = spark.read.parquet(f"{sf_small}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    side, small = ix._query_side(q, "query_id", "text")
    plan = ix._full(side, small)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert small and any("hashpartitioning(source" in line for line in dealt)
    assert not any("query_id" in line and "source" in line.split("), ")[0] for line in dealt), dealt


def test_floor_from_a_share_of_the_chunks_keeps_every_best_one(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = [(10_000 + i, t) for i, t in enumerate(["alpha beta gamma", "alpha beta", None, "", "x y", "alpha"] * 20)]
    rows += [(None, "alpha beta delta"), (None, "gamma gamma"), (10_001, "alpha alpha")]     # null and repeated keys
    ix = RT.BM25Index(RT.documents_as_chunks(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))))
    items = spark.read.parquet(f"{sf_small}/benchmark.parquet").limit(12)
    q = items.select(F.col("item_id").cast("string").alias("query_id"), "text").unionByName(spark.createDataFrame(
        [("ties", "alpha beta"), (None, "gamma alpha"), ("none", "zzzz qqqq"), ("", "delta")], "query_id string, text string"))
    side, small = ix._query_side(q, "query_id", "text")
    monkeypatch.setattr(RT, "FLOOR_CHUNKS", 40)
    monkeypatch.setattr(RT, "PAIRS_PER_TASK", 700)
    full = ix._totals(ix.tf, side, small).collect()
    for k in (1, 5):
        floors = {r["query_id"]: r["floor"] for r in ix.floors(side, small, k, 10_000).collect()}
        totals = {i: sorted((r["total"] for r in full if r["query_id"] == i), reverse=True) for i in floors}
        assert len(floors) > 5 and all(f <= totals[i][k - 1] for i, f in floors.items())
        key = lambda rows: sorted(rows, key=repr)
        assert key(ranked_any(ix.top_k(q, k))) == key(ranked_any(full_top(ix, q, k)))
        assert ix._best(side, small, k, 10_000).count() < len(full)     # what is under a floor is not sorted
    monkeypatch.setattr(RT, "FLOOR_CHUNKS", 10 ** 9)
    assert ix.floors(side, small, 5, 10_000) is None


def ranked_any(top):
    return [tuple(r[c] for c in ("query_id", "rank", "source", "section_no")) for r in top.select("query_id", "rank", "source", "section_no").collect()
            if r["source"] is not None]


def full_top(ix, q, k):
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ix.keys)
    return ix.scores(q).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > 0)).join(
        ix.lengths.select(*ix.keys), ix.keys)


def test_impacts_round_as_before(spark):
    """Nonnegative impacts are rounded without a decimal: halves go up, as ``round`` takes them."""
    xs = [0.0, 0.5, 1.5, 2.5, 12345678901.5, 12345678901.499998, 1e10 + 0.25, 3.999999999, 2.0 ** 40 - 0.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(
        F.floor(F.col("x") + F.lit(0.5)).alias("a"), F.round("x").cast("bigint").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_unmaterialized_index_counts_its_tokens_once(spark):
    """The text of a chunk is tokenized in one place of the plan, not once more in a filter for each token."""
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, "x")], "doc_id long, text string")
    ix = RT.BM25Index(RT.documents_as_chunks(docs), materialized=False)
    assert ix.tf._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r["source"], r["term"], r["tf"], r["dl"]) for r in ix.tf.collect()) == [(1, "alpha", 2, 3), (1, "beta", 1, 3)]
