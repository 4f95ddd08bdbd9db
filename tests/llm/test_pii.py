import hashlib
import itertools
import math
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kpiscope.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return sorted((m.start(), list(PLAIN).index(k), m.end()) for k, p in PLAIN.items()
                  for m in re.finditer(p, text) if checks(k, m[0]))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1 2.@-+()9é\n%0", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_base_spans_of_planted_cases():
    text = "é x.y+z@mail-1.example.com, 10.0.0.256 and 10.0.0.25.7 c 4539 1488 0343 6467 c +1 (389) 555-5010 a@b"
    assert P.base_spans(text) == brute(text) and [k for _, k, _ in P.base_spans(text)] == [0, 1, 2, 3]


def test_long_runs_are_linear():
    assert P.base_spans("1" * 200_000 + "." * 50_000 + "@" * 50_000 + "+" * 50_000) == []


def test_field_adds_consistent_spans(spark):
    rows = [(i, f"Call +1 (389) 555-{1000 + i} or write to user.{i}@mail.example.com from 10.1.{i % 200}.7 now {i}") for i in range(400)]
    rows += [(1000 + i, f"Chapter {i} of 12, page {i * 3}, year 19{i % 90 + 10}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = P.train_field(P.texts(docs))
    text = "Reach us at (389) 555-7777. Again: (389) 555-7777, page 12"
    added = P.field_spans(text, model, P.base_spans(text))
    assert {text[s:e] for s, _, e in added} <= {"(389) 555-7777", "555-7777"} and len(added) == 2
    assert {k for _, k, _ in added} == {3}
    assert P.field_spans("Chapter 3 of 12, page 9", model, []) == []
    assert P.mask(text, added).count("[phone]") == 2


def test_repeats_share_one_hub():
    tokens = P.candidates("x 555-1234567 " * 500)
    assert [len(g) for g in P.repeats(tokens)] == [500]
    far = P.candidates("n 1234567 " + "w " * 500 + "(555) 123-4567 and 12-34567 1234567")
    assert sorted(P.repeats(far)) == [(0, 2, 3, 4), (0, 4)]      # by digits; by form


def enumerated(model, tokens, observed):
    """Marginals of tokens and hubs by every labelling."""
    n, k, groups = len(tokens), len(P.LABELS), P.repeats(tokens)
    node = model.nodes(tokens, observed)
    edges = [(i - 1, i, model.chain) for i, t in enumerate(tokens) if t.linked and i]
    edges += [(i, n + h, model.skip) for h, g in enumerate(groups) for i in g]
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n + len(groups)):
        p = math.exp(sum(node[i, labels[i]] for i in range(n)) + sum(pot[labels[a], labels[b]] for a, b, pot in edges))
        for i in range(n):
            out[i, labels[i]] += p
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration_on_trees():
    rng = np.random.default_rng(2)
    k = len(P.LABELS)
    skip = np.eye(k) * 1.7
    for text in ("a1 b2 c3 d4", "a1 word a1 word word b2 a1", "1234567 w w 99-1234567 x2", "a1 b2 w w w b2 c3"):
        tokens = P.candidates(text)
        names = {f for t in tokens for f in P.features(t)}
        for observed in ({}, {0: 4}, {1: 2}):
            model = P.Field({f: rng.normal(size=k) for f in sorted(names)}, rng.normal(size=k), rng.normal(size=(k, k)), skip)
            got = model.marginals(tokens, observed)
            assert np.abs(got - enumerated(model, tokens, observed)).max() < 1e-3


def test_evidence_reaches_across_a_document():
    k = len(P.LABELS)
    model = P.Field({}, np.array([1.0, 0, 0, 0, 0]), np.zeros((k, k)), np.eye(k) * 3)
    text = "+1 389 555 5010 " + "word 7x " * 100 + "call 555-5010 " + "word " * 300 + "again 555-5010"
    tokens = P.candidates(text)
    repeat = [i for i, t in enumerate(tokens) if t.word == "555-5010"]
    assert model.marginals(tokens)[repeat].argmax(axis=1).tolist() == [0, 0]
    assert repeat[0] > 100 and model.marginals(tokens, {repeat[0]: 4})[repeat[1]].argmax() == 4


def test_one_long_text_takes_linear_time():
    size = 300_000
    model = P.Field({}, np.array([1.0, 0, 0, 0, 0]), np.zeros((5, 5)), np.eye(5))
    start = time.time()
    for text in ("a" * size + "@" + "b" * size, "b" * size + " x (at) y", "a@" * size, "a (at) b " * (size // 9),
                 "a(at)" * (size // 5), "1 x (at) y " * (size // 11), "+1" + "(" * size, "1." * size, "9" * size):
        base = P.base_spans(text)
        P.field_spans(text, model, base)
    assert time.time() - start < 60


def test_rows(odd_docs, no_docs):
    rows = P.find_pii(odd_docs).collect()
    assert len(rows) == 9
    empty = [r for r in rows if r["doc_id"] == 2][0]
    assert empty["spans"] == "" and empty["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["n_email"] for r in rows if r["doc_id"] is None] == [1]
    assert P.find_pii(no_docs).count() == 0
    out = P.masked(odd_docs)
    assert out.schema == odd_docs.schema
    kept = {r["doc_id"]: r for r in out.collect()}
    assert kept[None]["text"] == "No id, mail me at [email]" and kept[None]["n_chars"] == len("No id, mail me at [email]") and kept[2]["text"] is None
    assert P.masked(no_docs).count() == 0


def test_query_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in P.find_pii(docs).collect():
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        line = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(filter(None, r["spans"].split(",")))
