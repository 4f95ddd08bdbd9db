import corpus_pipeline as C
from test_simhash import brute_components, brute_fingerprint
from kpiscope.llm import decontam as D
from kpiscope.llm import pii as P
from kpiscope.llm import quality as Q
from kpiscope.llm.common import ascii_words, table


def test_stages_against_brute_force(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    labels, bench = table(spark, sf_small, "labels"), table(spark, sf_small, "benchmark")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]
    stage = dict(C.STAGES)

    kept = C.materialize(stage[names[0]](spark, docs, sf_small), "test")
    want = {r["doc_id"] for r in Q.quality(docs, labels).collect() if r["predicted"] == 1}
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == want

    one = C.materialize(stage[names[1]](spark, kept, sf_small), "test")
    rows = sorted((r["doc_id"], brute_fingerprint(r["text"])) for r in kept.collect())
    assert {r["doc_id"] for r in one.collect()} == set(brute_components(rows))

    clean = C.materialize(stage[names[2]](spark, one, sf_small), "test")
    windows = {tuple(w[i:i + 10]) for r in bench.collect() for w in [ascii_words(r["text"])] for i in range(max(1, len(w) - 9))}
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in (one, clean))
    assert clean.columns == docs.columns
    hit = 0
    for d, r in before.items():
        w = ascii_words(r["text"])
        bad = {j for i in range(len(w)) if tuple(w[i:i + 10]) in windows for j in range(i, i + 10)}
        left = [x for i, x in enumerate(w) if i not in bad]
        hit += bool(bad)
        if not left:
            assert d not in after
        else:
            assert ascii_words(after[d]["text"]) == left and after[d]["n_chars"] == len(after[d]["text"])
            assert bad or after[d]["text"] == r["text"]
    assert hit

    private = C.materialize(stage[names[3]](spark, clean, sf_small), "test")
    for r in private.collect():
        assert not P.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not P.candidates(after[r["doc_id"]]["text"]):
            assert r["text"] == after[r["doc_id"]]["text"]
    assert private.count() == clean.count()

    packed = stage[names[4]](spark, private, sf_small)
    assert {r["doc_id"] for r in packed.collect()} == set(after)


def test_run_and_registration(spark, sf_small):
    import __spark_entry__ as E
    queries = E.queries()
    assert queries["pipeline"] is C.run and sum(q.startswith("op") for q in queries) >= 10
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries}
    assert C.run(spark, sf_small).count() > 0


def test_odd_and_empty_tables_pass_every_stage(spark, sf_small, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        kept = docs
        for name, stage in C.STAGES:
            done = C.materialize(stage(spark, kept, sf_small), "odd")
            if name != "best-fit packing":
                assert done.columns == docs.columns, name
            kept = done
        if docs is no_docs:
            assert kept.count() == 0
        else:
            assert kept.count() > 0 and {r["doc_id"] for r in kept.collect()} >= {None}
