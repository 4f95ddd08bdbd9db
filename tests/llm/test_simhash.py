import numpy as np
import pytest
import xxhash

from kpiscope.llm import simhash as S


def brute_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(rows, bits=3):
    """doc ids and fingerprints to the smallest id reachable."""
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("text", ["", " \n", "one", "One two", "a b c d e f g", "x y z q r s", "Ä ß É a\x0bb\x1cc d"])
def test_fingerprint(text):
    assert S.fingerprint(text, 3) == brute_fingerprint(text)


@pytest.mark.parametrize("n, centres, chunk", [(600, 5, 64), (400, 1, 50), (300, 40, 10_000)])
def test_links_connect_what_distances_connect(spark, n, centres, chunk):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2 ** 63, centres, dtype=np.uint64)
    fps = [int(base[i % centres]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)))) for i in range(n)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r["node"]: r["root"] for r in S.components(S.near_links(frame, 3, chunk)).collect()}
    got = {}
    for f, s in zip(fps, signed):
        got.setdefault(root.get(s, s), []).append(f)
    comp = brute_components([(f, f) for f in fps])
    want = {}
    for f, c in zip(fps, comp):
        want.setdefault(c, []).append(f)
    assert sorted(got.values()) == sorted(want.values())


def test_long_chain_settles(spark):
    frame = spark.range(300).select((F_col("id") + 1).alias("a"), F_col("id").alias("b"))
    assert {r["root"] for r in S.components(frame).collect()} == {0}


def F_col(name):
    from pyspark.sql import functions as F
    return F.col(name)


def test_table_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs, 3, 3).collect()} == want
    kept = {r["doc_id"] for r in S.one_of_each(docs, 3, 3).collect()}
    assert kept == {c for _, c in want.values()} and len(kept) < len(want)


def test_odd_rows(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs, 3, 3).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert by[6]["component_id"] == 1 and by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert by[2]["fingerprint"] == "0" * 16 and by[None]["component_id"] is None
    out = S.one_of_each(odd_docs, 3, 3)
    assert out.schema == odd_docs.schema and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "5", "7", "None"]
    twice = odd_docs.where("doc_id = 6")
    assert S.one_of_each(twice, 3, 3).count() == 1
    assert S.near_duplicates(no_docs, 3, 3).count() == 0 and S.one_of_each(no_docs, 3, 3).count() == 0
