import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from kpiscope.llm import spelling as S
from kpiscope.llm.queries import ORACLE, op11_spelling_variants


def brute_counts(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_variants(counts):
    """Every word against every other."""
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= 10 * counts[w]:
                form[w] = best
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        rows.append((w, f, root, n, len(near[w]), counts[f] if f else None))
    return sorted(rows)


def got(frame):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect())


def test_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    counts = brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["word"]: r["n"] for r in S.word_counts(docs).collect()} == counts
    # brute force compares all pairs: of the words, those of the commonest lengths would take minutes
    words = {w: n for w, n in counts.items() if w[0] in "aeé"}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = S.near_words(frame).select("word", "near").collect()
    want = sorted((w, v) for w in words for v in words if abs(len(w) - len(v)) < 2 and one_edit(w, v))
    assert sorted((r["word"], r["near"]) for r in pairs) == want and want


def test_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    rows = con.execute("SELECT word, form, root, n, n_near, form_n FROM (" + ORACLE["op11_spelling_variants"] + ")").fetchall()
    assert sorted(rows, key=lambda r: r[0]) == got(op11_spelling_variants(spark, sf_small))


def chained():
    """Counts 2, 30, 400 and 5,000 one edit apart each: a chain of forms."""
    words = {"abcdefgh": 5000, "abcdefghi": 400, "abcdefghij": 30, "abcdefghijk": 2, "abcdefgx": 400, "bcdefgh": 499,
             "abcdeféh": 40, "Écoleàb": 90, "écoleàb": 900, "zzzzzzz": 3}
    def whole(w):       # an id under which the word keeps all its letters
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), w)
        return next(i for i in range(100) if zlib.crc32(f"{i}:{lowered}".encode()) % 31)
    return [(whole(w), " ".join([w] * n)) for w, n in words.items()]


@pytest.mark.parametrize("symbols", [1, 2, 12])
def test_chains_ties_and_letters_beyond_ascii(spark, symbols):
    docs = chained()
    want = brute_variants(brute_counts(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(S.variants(frame, symbols)) == want
    root = {w: r for w, _, r, *_ in want}
    assert root["abcdefghijk"] == "abcdefgh" and sum(f is not None for _, f, *_ in want) >= 5


def test_odd_rows(spark, odd_docs, no_docs):
    long = ("ab" * 30_000, "ba" + "ab" * 29_999)
    docs = odd_docs.unionByName(spark.createDataFrame([(90 + i, f"{t} {t}") for i, t in enumerate(long)], "doc_id long, text string"),
                                allowMissingColumns=True)
    want = brute_variants(brute_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert got(S.variants(docs)) == want and len(want) >= 2
    assert S.variants(no_docs).count() == 0


def test_one_edit_of_long_words(spark):
    base = "abcdé" * 20
    words = [base, base[1:], base[:-1], base[:50] + base[51:], base[:50] + "x" + base[50:], base[:50] + "x" + base[51:], "x" + base,
             base + "x", base[:-1] + "x", "x" + base[1:], base[2:], base[1:] + "a", base + "xx", base[1:-1], "é" + base[:-1]]
    frame = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in frame.select("a", "b", S.one_edit(frame.a, frame.b).alias("near")).collect():
        assert r["near"] == one_edit(r["a"], r["b"]), (r["a"], r["b"])


def test_neighbourhoods_are_full():
    make = S.Neighbourhoods({"a": 1, "b": 2, "c": 1, "d": 3}, 3)
    word = "abcdabd"
    keys = {int(k) for matrix in make.around([word]) for k in matrix[:, 0]}
    letters = "acbd"
    edits = {word[:i] + word[i + 1:] for i in range(7)} | {word[:i] + c + word[i + 1:] for i in range(7) for c in letters}
    edits |= {word[:i] + c + word[i:] for i in range(8) for c in letters}
    assert keys == {int(make.keys([w])[0]) for w in edits | {word}}


def test_filter_has_no_false_negatives(spark):
    frame = spark.range(3000).selectExpr("concat('word', lpad(cast(id as string), 7, 'x')) as word", "2L as n")
    alphabet = {c: i % 5 + 1 for i, c in enumerate("wordx0123456789")}
    keyed = S.keyed_words(frame, alphabet, 5)
    keys = np.array([r["key"] for r in keyed.collect()], np.int64).view(np.uint64)
    for max_bits in (S.MAX_BITS, S.SLICE_BITS):
        held = np.unpackbits(S.bloom_filter(keyed, 3000, max_bits=max_bits), bitorder="little")
        for at in S.filter_places(keys, len(held)):
            assert held[at.astype(np.int64)].all()
        assert held.sum() <= 2 * len(keys)
