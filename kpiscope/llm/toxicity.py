"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and
digits or signs inside words to the letters they stand for. The lexicon is
learned from labelled documents: whole words and word beginnings whose
contexts and documents are far commoner in the toxic class. Counting distinct neighbouring
words instead of documents keeps one much-copied document from filling the
lexicon with its own words. Each matched word counts with its heaviest entry,
unless an exception phrase covers it; sums are normalised by the text's length
and a logistic curve over them gives the score.

Defined cases: an empty or null text has no match and the score of a text
without matches; without labels of both classes the lexicon is empty and every
score is 0. Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.common import enter, fit_logistic, held_out, sigmoid, texts, training_docs

# ---- fixed values: look-alikes, substitutions, exception phrases ----
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
EXCEPTION_PHRASES = (
    "trash can", "trash bin", "trash collection", "pond scum", "soap scum",
    "sore loser", "circus clown", "clown fish", "not stupid", "worthless check",
)
# ---- end of fixed values ----

PER_CLASS = 4000        # labelled documents of each class that the model is fitted on
PAIRS_HELD = 200_000    # pairs of term and neighbour that a task holds before it passes them on
MIN_CONTEXTS = 5        # distinct neighbours that an entry needs in toxic documents, at least,
MIN_SURPRISE = 16.0     # and so many that chance alone has odds of exp(-16) to put them all there
PREFIXES = range(3, 9)  # lengths of word beginnings that may become entries

_LOOK = str.maketrans(LOOKALIKES)
_SUB = str.maketrans(SUBSTITUTIONS)
_NO_WORD = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$"}
                         | {c: " " for c in " ‘’“”–—…«»¿¡"})
_MIXED = re.compile(r"(?<!\S)[^\s0-9@$]*+[0-9@$]\S*+")     # tried at the start of a word only
_SIGN = re.compile(r"(?<!\w)[@$]+|[@$]+(?!\w)|[@$]{2,}")


def _unmix(m: re.Match) -> str:
    word = _SIGN.sub(" ", m[0])
    return word.translate(_SUB) if any(c.isalpha() for c in word) else word


def fold(text: str) -> str:
    """The text's folded words, each between single blanks."""
    low = text.lower()
    if not low.isascii():
        if not unicodedata.is_normalized("NFKC", low):
            low = unicodedata.normalize("NFKC", low)
        low = low.translate(_LOOK)
    low = low.translate(_NO_WORD)
    if _MIXED.search(low):
        low = _MIXED.sub(_unmix, low)
    return f" {' '.join(low.split())} "


@dataclass
class Lexicon:
    """Entries ' word ' (whole word) or ' begin' (word beginning) with weights,
    and the logistic weights over (sum, sum per root word, heaviest, intercept)."""

    entries: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, -40.0)

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            a.add_word(entry, (len(entry), weight))
        for phrase in EXCEPTION_PHRASES:
            a.add_word(f" {fold(phrase).strip()} ", (-len(fold(phrase)), 0.0))
        a.make_automaton()
        return a


def measures(folded: str, automaton) -> tuple[int, float, float, float]:
    """Matched words, their weights' sum, the sum per root of the text's words, the heaviest weight."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        if size < 0:
            spared.append((end + size + 1, end))
        else:
            start = end - size + 1
            best[start] = max(weight, best.get(start, 0.0))
    for lo, hi in spared:
        for start in range(lo, hi):         # an exception phrase is short
            best.pop(start, None)
    total = sum(best.values())
    return len(best), total, total / math.sqrt(folded.count(" ")), max(best.values(), default=0.0)


def _term_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a term and its left neighbour by class. ``docs`` are the documents whose first such
    term has that neighbour, so their sum over a term's pairs is the number of its documents."""
    for b in batches:
        for y in (0, 1):
            pairs: dict[tuple[str, str], int] = {}
            for text in b["text"][b["y"] == y]:
                before, met, known = "", set(), set()
                for w in fold(text).split():
                    if (w, before) not in known:
                        known.add((w, before))
                        for term in (f" {w} ", *(f" {w[:n]}" for n in PREFIXES if n <= len(w))):
                            pairs[term, before] = pairs.get((term, before), 0) + (term not in met)
                            met.add(term)
                    before = w
                if len(pairs) > PAIRS_HELD:
                    yield _pair_rows(pairs, y)
                    pairs = {}
            if pairs:
                yield _pair_rows(pairs, y)


def _pair_rows(pairs: dict[tuple[str, str], int], y: int) -> pd.DataFrame:
    return pd.DataFrame({"term": [t for t, _ in pairs], "before": [w for _, w in pairs],
                         "y": np.full(len(pairs), y, np.int32), "docs": np.fromiter(pairs.values(), np.int64, len(pairs))})


def learn_lexicon(train: DataFrame) -> Lexicon:
    """Entries and curve from ``doc_id, text, y`` rows (bounded by the caller)."""
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(n) != {0, 1}:
        return Lexicon()
    toxic = F.col("y") == 1
    terms = (train.mapInPandas(_term_contexts, "term string, before string, y int, docs long").groupBy("term", "before")
             .agg(F.max(toxic.cast("long")).alias("pos"), F.max((~toxic).cast("long")).alias("neg"),
                  F.sum(F.when(toxic, F.col("docs")).otherwise(0)).alias("pos_docs"),
                  F.sum(F.when(toxic, 0).otherwise(F.col("docs"))).alias("neg_docs"))
             .groupBy("term").agg(*(F.sum(c).alias(c) for c in ("pos", "neg", "pos_docs", "neg_docs"))))
    least = max(MIN_CONTEXTS, MIN_SURPRISE / -math.log(n[1] / (n[0] + n[1])))
    odds = F.log((F.col("pos") + 0.5) / n[1]) - F.log((F.col("neg") + 0.5) / n[0])
    # neighbours run out where a vocabulary is small, documents do not: both have to be that much commoner
    commoner = [F.col(c) * n[0] > 12 * (F.col(d) + 0.25) * n[1] for c, d in (("pos", "neg"), ("pos_docs", "neg_docs"))]
    rows = (terms.where((F.col("pos") >= min(least, 40.0)) & commoner[0] & commoner[1])
            .withColumn("w", odds).orderBy(F.desc(F.col("w") * F.sqrt("pos")), "term").collect())
    if not rows:
        return Lexicon()
    heaviest = max(r["w"] for r in rows)
    lexicon = Lexicon({r["term"]: float(r["w"] / heaviest) for r in rows})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for b in batches:
            got = [measures(fold(t), automaton)[1:] for t in b["text"]]
            yield pd.DataFrame(got, columns=["s", "r", "m"]).assign(y=b["y"].to_numpy())

    fit = train.mapInPandas(features, "s double, r double, m double, y int").toPandas()
    lexicon.curve = tuple(map(float, fit_logistic(fit[["s", "r", "m"]].to_numpy(), fit["y"].to_numpy(float), 1e-4)))
    return lexicon


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_matches`` of every whole text."""
    lexicon = learn_lexicon(training_docs(docs, labels, "toxic", per_class))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        automaton = lexicon.automaton()
        *weights, bias = lexicon.curve
        for b in batches:
            got = np.array([measures(fold(t), automaton) for t in b["text"]], dtype=float).reshape(-1, 4)
            score = sigmoid(got[:, 1:] @ np.array(weights) + bias)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score, "n_matches": got[:, 0].astype("int64")})

    return (texts(docs).mapInPandas(run, "doc_id long, score double, n_matches long")
            .select("doc_id", held_out().alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches"))
