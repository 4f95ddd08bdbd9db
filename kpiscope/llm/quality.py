"""Quality classifier: a sparse rule ensemble over text statistics.

Every whole text is reduced to a row of statistics. On a bounded labelled sample
small trees are boosted; each path from a root to a node is a conjunctive rule
over statistics. A lasso-penalised logistic regression (proximal gradient with
acceleration) keeps few rules, and those are compiled into one Spark column
expression over the statistics, which scores all documents.

Defined cases: an empty or null text has all statistics zero and the score of
such a text; without labels of both classes every document scores the share of
label 1, or 1.0 without labels (keep, since nothing says otherwise). Repeated
rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.common import enter, held_out, sigmoid, texts, training_docs

PER_CLASS = 4000        # labelled documents of each class that the rules are fitted on, at most about
TREES = 40
DEPTH = 3
BINS = 24
LASSO = 2e-3
THRESHOLD = 0.3

STATISTICS = (
    "log_words", "mean_word", "upper_share", "digit_share", "sign_share", "rare_sign_share", "blank_share",
    "line_share", "short_line_share", "repeated_line_share", "distinct_words", "repeat_next", "top_word",
    "signed_words", "capital_words", "lone_signs", "stop_share", "longest_word",
)
# classes of bytes: 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, 6 common sign, 7 other sign, 8 non-ASCII
_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 5 if b in (10, 13)
                   else 4 if b in (9, 11, 12, 32) else 6 if chr(b) in ".,;:'\"()?-" else 8 if b >= 128 else 7
                   for b in range(256)], np.uint8)
_COMMON = b".,;:'\"()?-"
_ENDS = b".?!:"


def statistics(text: str) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, size = len(words), len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)
    letters = max(1, int(kinds[1] + kinds[2]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    signed = capital = lone = longest = ended = 0
    for w, k in counts.items():
        bare = w.rstrip(_COMMON)
        if not bare.isascii() or not bare.isalpha():
            core = bare.strip(b"!%&$*#|@^~_=+<>/\\[]{}`-")
            if not core:
                lone += k
            elif core is not bare and len(core) < len(bare):
                signed += k
        if len(bare) > 1 and w.isupper():
            capital += k
        if w[-1] in _ENDS:
            ended += k
        longest = max(longest, len(w))
    return (
        float(np.log1p(n)), sum(map(len, words)) / n, kinds[1] / letters, kinds[3] / size, kinds[6] / size,
        kinds[7] / size, kinds[4] / size, kinds[5] / size * 10, sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)), len(counts) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        max(counts.values()) / n, signed / n, capital / n, lone / n, ended / n, float(np.log1p(longest)))


_RETURN = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])


@F.pandas_udf(_RETURN)
def statistics_column(text: pd.Series) -> pd.DataFrame:
    enter("quality")
    return pd.DataFrame([statistics(t) for t in text], columns=list(STATISTICS), dtype=float)


# ---------------------------------------------------------------------- trees
@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    value: float = 0.0


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray,
         rows: np.ndarray, depth: int) -> Node:
    """Second-order regression tree over binned statistics."""
    g, h = grad[rows].sum(), hess[rows].sum()
    node = Node(value=-g / (h + 1.0))
    if depth == 0 or len(rows) < 20:
        return node
    best = (1e-3, -1, 0)
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        c = codes[rows, f]
        gl = np.cumsum(np.bincount(c, grad[rows], len(at) + 1))[:-1]
        hl = np.cumsum(np.bincount(c, hess[rows], len(at) + 1))[:-1]
        nl = np.cumsum(np.bincount(c, minlength=len(at) + 1))[:-1]
        gain = gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1)
        gain[(nl < 5) | (len(rows) - nl < 5)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return node
    _, node.feature, k = best
    node.cut = float(cuts[node.feature][k])
    low = codes[rows, node.feature] <= k
    node.low = grow(x, grad, hess, cuts, codes, rows[low], depth - 1)
    node.high = grow(x, grad, hess, cuts, codes, rows[~low], depth - 1)
    return node


def predict_tree(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x))
    out[low], out[~low] = predict_tree(node.low, x[low]), predict_tree(node.high, x[~low])
    return out


Rule = tuple[tuple[int, bool, float], ...]      # (statistic, whether <=, cut), all must hold


def paths(node: Node, above: tuple = ()) -> Iterator[Rule]:
    """Each path from the root to a node as a rule; bounds on one statistic are merged."""
    if above:
        bounds: dict[tuple[int, bool], float] = {}
        for f, low, cut in above:
            old = bounds.get((f, low))
            bounds[f, low] = cut if old is None else min(old, cut) if low else max(old, cut)
        yield tuple(sorted((f, low, cut) for (f, low), cut in bounds.items()))
    if node.low is not None:
        yield from paths(node.low, (*above, (node.feature, True, node.cut)))
        yield from paths(node.high, (*above, (node.feature, False, node.cut)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


@dataclass
class RuleEnsemble:
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    bias: float = 40.0

    def column(self, stats: Column) -> Column:
        """The ensemble as one Spark expression over a column of statistics."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            test = None
            for f, low, cut in rule:
                s = stats[STATISTICS[f]]
                t = (s <= cut) if low else (s > cut)
                test = t if test is None else test & t
            z = z + F.when(test, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (1 + F.exp(-z))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(sum((holds(r, x) * w for r, w in self.rules), np.full(len(x), self.bias)))


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the L1-penalised logistic loss; the intercept is free."""
    n, k = a.shape
    lipschitz = 0.25 * (np.linalg.norm(np.column_stack([a, np.ones(n)]), 2) ** 2) / n
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = (sigmoid(a @ vw + vb) - y) / n
        new = vw - (a.T @ r) / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lipschitz, 0.0)
        nb = vb - r.sum() / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, float(b)


def learn_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Boost small trees, take their paths as rules, keep few by the lasso."""
    if not len(y):
        return RuleEnsemble()
    if y.min() == y.max():
        return RuleEnsemble(bias=40.0 if y[0] else -40.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = sigmoid(z)
        tree = grow(x, p - y, p * (1 - p), cuts, codes, np.arange(len(y)), DEPTH)
        if tree.low is None:
            break
        z = z + 0.3 * predict_tree(tree, x)
        rules.update(dict.fromkeys(paths(tree)))
    names = list(rules)
    a = np.column_stack([holds(r, x) for r in names]).astype(float) if names else np.zeros((len(y), 0))
    some = [i for i in range(len(names)) if 0 < a[:, i].mean() < 1]
    w, bias = lasso_logistic(a[:, some], y.astype(float), LASSO)
    return RuleEnsemble([(names[i], float(v)) for i, v in zip(some, w) if abs(v) > 1e-6], bias)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> RuleEnsemble:
    chosen = training_docs(docs, labels, "quality", per_class)
    rows = chosen.select("doc_id", "y", statistics_column("text").alias("s")).select("doc_id", "y", "s.*").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    return learn_rules(rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(int))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    model = train(docs, labels, per_class)
    scored = texts(docs).select("doc_id", statistics_column("text").alias("s")).select(
        "doc_id", held_out().alias("held_out"), model.column(F.col("s")).alias("score"))
    return scored.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    model = train(docs, labels, per_class)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (docs.select(F.struct("*").alias("row"), statistics_column(text).alias("s"))
            .where(model.column(F.col("s")) >= THRESHOLD).select("row.*"))
