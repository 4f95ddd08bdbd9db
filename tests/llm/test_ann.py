import numpy as np
import pytest

from kpiscope.llm import ann as A


def frame(spark, ids, x, extra="e"):
    rows = [(int(i), [float(c) for c in v] if v is not None else None, "l", 1.0) for i, v in zip(ids, x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, score double")


def brute(ids, x, every, k):
    out = {}
    for i in [j for j in range(len(ids)) if ids[j] % every == 0]:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in others[np.lexsort((ids[others], d[others]))][:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("n, clusters", [(3000, 0), (3000, 30)])
def test_recall_and_exact_scores(spark, n, clusters):
    rng = np.random.default_rng(n + clusters)
    x = rng.normal(size=(n, 24)).astype(np.float32)
    if clusters:
        x = (rng.normal(size=(clusters, 24))[rng.integers(0, clusters, n)] + 0.2 * x).astype(np.float32)
    ids, x = np.arange(n), x.astype(float)
    got, want = result(A.nearest(frame(spark, ids, x), 100, 10, sample_vectors=1000)), brute(ids, x, 100, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 10 for q in want]) >= 0.9
    for q, found in got.items():
        for v, s in found:
            assert abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12


def test_probing_finds_all_codes_in_the_ball():
    rng = np.random.default_rng(0)
    for n in (2000, 40):
        codes = rng.integers(0, 1 << 16, (n, 4), dtype=np.uint16)
        index = A.MultiIndex(codes)
        for radius in (0, 3, 7, 10, 15, 32, 64):
            for q in codes[:20]:
                assert index.within(q, radius).tolist() == np.flatnonzero(A.hamming(codes, q) <= radius).tolist()


def shard_search(x, sample, queries, k=10):
    """Shares of rows probed and reranked, and recall, of searches in one shard."""
    codes = A.learn_codes(x[sample])
    reach, index, ids = A.learn_reach(x[sample], codes, k), A.MultiIndex(codes.encode(x)), np.arange(len(x))
    limits = A.first_limits(sample, x[sample], queries, x[queries], k)
    probed = reranked = right = 0
    for i, limit in zip(queries, limits):
        best = A.Best(np.zeros(0, np.int64), np.zeros(0), limit)
        p, r = A.search_shard(index, ids, x, i, x[i], index.codes[i], best, reach, k)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        others = np.flatnonzero(ids != i)
        want = others[np.lexsort((others, d[others]))][:k]
        assert np.allclose(best.distance, d[best.ids], rtol=0, atol=1e-12) and limit >= np.sort(d[others])[k - 1]
        probed, reranked, right = probed + p, reranked + r, right + len(set(want) & set(best.ids.tolist()))
    n = len(queries)
    return probed / n / len(x), reranked / n / len(x), right / n / k


def test_index_probes_few_rows_of_clustered_vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 32))[rng.integers(0, 200, 12_000)] + 0.1 * rng.normal(size=(12_000, 32))
    probed, reranked, recall = shard_search(x, np.sort(rng.choice(12_000, 4000, replace=False)), np.arange(0, 12_000, 60))
    assert recall >= 0.95 and probed < 0.25 and reranked < 0.05, (probed, reranked, recall)


def test_vectors_without_clusters_keep_their_recall():
    x = np.random.default_rng(5).normal(size=(4000, 32))
    assert shard_search(x, np.arange(0, 4000, 4), np.arange(0, 4000, 40))[2] >= 0.9


def test_repeated_queries_repeat_their_results_and_meet_the_index_once(spark):
    rng = np.random.default_rng(8)
    ids = np.array([0] * 300 + list(range(1, 201)))
    x = np.concatenate([np.repeat(rng.normal(size=(2, 5)), 150, axis=0), rng.normal(size=(200, 5))]).astype(np.float32).astype(float)
    out = A.nearest(frame(spark, ids, x), 100, 4, sample_vectors=1000)
    counts = {(r["query_id"], r["rank"]): r["count"] for r in out.groupBy("query_id", "rank").count().collect()}
    assert counts == {**{(0, r): 300 for r in range(1, 5)}, **{(q, r): 1 for q in (100, 200) for r in range(1, 5)}}
    assert out.where("vec_id = query_id").count() == 0


def test_invalid_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1, 0], [1, 0], [1, 0], [0, 0], None, [nan, 1], [inf, 0], [2, 0], [1, 0, 0], [5, 5]]
    ids = [0, 3, 2, 4, 5, 6, 7, 8, 9, 100]
    df = frame(spark, ids, x)
    df = df.unionByName(spark.createDataFrame([(200, [None, 1.0], "l", 1.0), (None, [1.0, 1.0], "l", 1.0)], df.schema))
    got = result(A.nearest(df, 100, 10))
    assert set(got) == {0, 100} and [v for v, _ in got[0]] == [2, 3, 8, 100] and got[0][0][1] == 0.0
    assert A.nearest(df.where("1=0"), 100, 10).count() == 0
    assert A.nearest(df.where("vec_id = 0"), 100, 10).count() == 0


def test_many_equal_vectors(spark):
    x = np.ones((500, 8))
    x[::7] = np.random.default_rng(1).normal(size=x[::7].shape)
    got = result(A.nearest(frame(spark, np.arange(500), x), 100, 10))
    want = brute(np.arange(500), x.astype(np.float32).astype(float), 100, 10)
    assert {q: [v for v, _ in f] for q, f in got.items() if q % 7} == {q: [v for v, _ in f] for q, f in want.items() if q % 7}


def test_vectors_of_each_length_are_searched(spark):
    rng = np.random.default_rng(6)
    ids, x = np.arange(600), [rng.normal(size=6 if i % 3 else 9).astype(np.float32).astype(float) for i in range(600)]
    got = result(A.nearest(frame(spark, ids, x), 50, 5, sample_vectors=1000))
    for d in (6, 9):
        own = np.array([i for i in ids if len(x[i]) == d])
        want = brute(own, np.array([x[i] for i in own]), 50, 5)
        assert want and all(len(got[q]) == 5 and all(v in own for v, _ in got[q]) for q in want)
        assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want]) >= 0.9
