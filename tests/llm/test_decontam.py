import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiscope.llm import decontam as D
from kpiscope.llm.common import ascii_words


def brute(docs, items, window=10):
    windows = {}
    for item_id, text in items:
        w = ascii_words(text or "")
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        words, hit, found = ascii_words(text or ""), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[i:i + size])):
                    hit.update(range(i, i + size))
                    found |= {x for x in ids if x is not None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200))
def test_index_counts_and_locates(symbols):
    seq = np.array([*symbols, 0], np.int32)
    order = D.suffix_array(seq)
    assert sorted(order.tolist()) == list(range(len(seq)))
    index = D.FMIndex(seq, 4, every=3)
    phrases = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    lo, hi = index.search(np.array(phrases, np.int32), np.full(9, 2))
    for (a, b), x, y in zip(phrases, lo, hi):
        places = [i for i in range(len(seq) - 1) if (seq[i], seq[i + 1]) == (a, b)]
        assert sorted(index.locate(np.arange(x, max(x, y))).tolist()) == places


def _same(spark, docs, items, window):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, D.decontamination(frame, bench, window).collect()), key=str)
    assert got == sorted(brute(docs, items, window), key=str)


def test_small_tables_against_brute_force(spark):
    rng = np.random.default_rng(1)
    def text(n):
        return " ".join(rng.choice(list("abcd"), n))
    items = [(i, text(rng.integers(0, 14))) for i in range(6)] + [(3, "a b"), (7, None), (8, "Z-z ü"), (None, "b b b b b")]
    docs = [(i, text(rng.integers(0, 400))) for i in range(60)] + [(100, None), (101, ""), (102, "z Z,ü! a"), (102, "z Z,ü! a")]
    _same(spark, docs, items, 4)
    _same(spark, docs, items, 10)
    _same(spark, docs, [], 10)


def test_blocks_of_items_merge(spark, odd_docs):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(30)) + " y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, " ".join(f"w{i}" for i in range(8, 30)))],
                                  "item_id long, text string")
    own = docs.select(D.leak_column(bench, block_chars=10)("text").alias("k")).select("k.*").collect()[0]
    assert [tuple(s) for s in own["spans"]] == [(1, 31)] and own["items"] == ["1", "2"]
    out = D.decontaminated(odd_docs, bench)
    assert out.schema == odd_docs.schema and out.count() == odd_docs.count()


def test_cut_text_keeps_the_rest():
    assert D.without_spans("é One, two THREE - four!", [(1, 3)]) == "é  THREE - four!"
    docs = [("keep a b c d e f g h i j end", [(1, 11)])]
    assert D.without_spans(*docs[0]) == "keep  end"


def test_table_against_brute_force(spark, sf_small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    _same(spark, docs, items, 10)
    assert any(r[-1] for r in brute(docs, items))


def test_empty(no_docs, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.decontamination(no_docs, bench).count() == 0 and D.decontaminated(no_docs, bench).count() == 0
