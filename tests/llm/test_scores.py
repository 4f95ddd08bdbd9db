import zlib

import numpy as np
import pytest

from kpiscope.llm import quality as Q
from kpiscope.llm import toxicity as X
from kpiscope.llm.common import held_out


@pytest.fixture(scope="module")
def labelled(spark):
    base = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")


@pytest.mark.parametrize("score, label, least", [(Q.quality, "quality", 0.97), (X.toxicity, "toxic", 0.95)])
def test_held_out_accuracy(labelled, score, label, least):
    docs, labels = labelled
    rows = score(docs, labels).join(labels, "doc_id").collect()
    fold = [r for r in rows if r["held_out"]]
    assert fold and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == r[label] for r in fold]) >= least
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_of_the_fold_do_not_matter(labelled):
    from pyspark.sql import functions as F
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in Q.quality(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in Q.quality(docs, turned).collect()}
    assert a == b


@pytest.mark.parametrize("score", [Q.quality, X.toxicity])
def test_odd_rows(odd_docs, no_docs, no_labels, labelled, score):
    rows = score(odd_docs, labelled[1]).collect()
    assert len(rows) == 9 and all(r["score"] is not None and r["predicted"] in (0, 1) for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert score(no_docs, no_labels).count() == 0
    assert len(score(odd_docs, no_labels).collect()) == 9


def test_rule_column_equals_numpy(spark, labelled):
    docs, labels = labelled
    model = Q.train(docs, labels)
    assert 0 < len(model.rules) < 200 and all(len(r) <= 2 * Q.DEPTH for r, _ in model.rules)
    texts = [r["text"] for r in docs.limit(100).collect()]
    want = model.scores(np.array([Q.statistics(t) for t in texts]))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = frame.select("i", model.column(Q.statistics_column("text")).alias("s")).orderBy("i").collect()
    assert np.allclose([r["s"] for r in got], want)


def test_accepted_keeps_all_columns(odd_docs, labelled):
    out = Q.accepted(odd_docs, labelled[1])
    assert out.schema == odd_docs.schema and out.where("doc_id = 1").count() == 1


def test_folding_and_exceptions():
    assert X.fold("ІDІ0T, m0r0n! $tupid 2020 $$$ café") == " idiot moron stupid 2020 café ".replace("stupid", "tupid")
    lexicon = X.Lexicon({" scum ": 1.0, " mor": 0.5, " moron ": 0.9}, (1.0, 0.0, 0.0, -1.0))
    a = lexicon.automaton()
    assert X.measures(X.fold("Scum and m0rons, a moron"), a)[:2] == (3, 1.0 + 0.5 + 0.9)
    assert X.measures(X.fold("pond scum"), a)[0] == 0
    assert X.measures(X.fold(""), a) == (0, 0.0, 0.0, 0.0)


def toxic_rows(spark, n_clean, n_toxic, word_in_clean):
    """Every text has "common" beside 30 of 200 neighbours; toxic texts and a few clean ones have "zorvex"."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n_clean + n_toxic):
        toxic = int(i >= n_clean)
        words = [f"side{k} common" for k in rng.choice(200, 30, replace=False)]
        rows.append((i, " ".join(words + [f"left{i} zorvex"] * (toxic or i < word_in_clean)), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_counts_of_contexts_go_on_beyond_64(spark):
    entries = X.learn_lexicon(toxic_rows(spark, 300, 300, 8)).entries
    assert " zorvex " in entries and " common " not in entries


def test_common_words_are_no_entries_with_few_toxic_labels(spark):
    entries = X.learn_lexicon(toxic_rows(spark, 400, 20, 0)).entries
    assert " zorvex " in entries and " common " not in entries


def test_every_term_that_passes_is_an_entry(spark):
    rows = [(i, " ".join(f"n{i}x{k} z{k:04d}q" for k in range(1100)) if i % 2 else "a plain text", i % 2) for i in range(60)]
    entries = X.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int")).entries
    assert len([e for e in entries if e.endswith(" ")]) == 1100


def plain_measures(folded, entries):
    """Every entry tried at every place of the text."""
    best, spared = {}, set()
    for at in range(len(folded)):
        for entry, weight in entries.items():
            if folded.startswith(entry, at):
                best[at] = max(weight, best.get(at, 0.0))
        for phrase in X.EXCEPTION_PHRASES:
            if folded.startswith(f" {phrase} ", at):
                spared.update(range(at, at + len(phrase) + 1))
    best = {at: w for at, w in best.items() if at not in spared}
    return len(best), sum(best.values()), sum(best.values()) / folded.count(" ") ** 0.5, max(best.values(), default=0.0)


def test_measures_equal_a_plain_matcher():
    import random
    rng = random.Random(3)
    model = X.Lexicon({" stupid ": 2.0, " tra": 1.0, " trash ": 3.0, " scum ": 1.5, " clo": 0.5, " los": 0.25})
    automaton = model.automaton()
    words = "stupid trash can not scum pond clown circus loser sore tray clone good day".split()
    for _ in range(2000):
        folded = X.fold(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))))
        got, want = X.measures(folded, automaton), plain_measures(folded, model.entries)
        assert got[0] == want[0] and np.allclose(got, want)


def test_one_long_text_folds_in_linear_time():
    import time
    start = time.time()
    for text in ("a" * 1_000_000, "1 " + "a" * 1_000_000, "@" * 500_000, "a@" * 500_000, "trash can stupid " * 50_000):
        X.measures(X.fold(text), X.Lexicon({" stupid ": 2.0, " trash ": 1.0}).automaton())
    assert time.time() - start < 30
