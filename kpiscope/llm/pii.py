"""PII: base patterns plus a skip-chain conditional random field.

Base spans come from four patterns with their checks (Luhn, digit counts,
octets). The field labels the *candidate tokens* of a document (blank-separated
tokens holding a digit or an at sign, or a spelled-out address): every other
token is fixed to "no entity", so it takes no message and the chain may be cut
there without changing any marginal. Neighbouring candidates share a chain
potential. The tokens of a document that have the same normalised form, or the same
last seven digits, share skip potentials with one hub variable: one edge per token,
and two steps between any two repeats however far apart they stand. Tokens that base
spans cover are observed. Loopy sum-product messages run over chain and skip edges
until they settle. Tokens whose marginal favours an entity become spans unless a base
span covers them; base spans always stay.

Node weights are a softmax regression over token shape, length, digit groups
and the neighbouring words, fitted on a bounded hash sample of documents whose
base spans serve as labels; chain and skip potentials are label co-occurrence
ratios of the same sample.

Defined cases: a null or empty text has no spans (counts 0, spans '', the
digest of the empty string). Every row is judged alone, so repeated rows get equal
results, a null id is kept, and an empty table gives an empty result. Long texts are read
whole, in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.common import enter, texts, with_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS = 20_000    # documents whose candidate tokens the field is fitted on, about
SETTLED = 1e-4          # messages that change by less are settled
BP_ROUNDS = 200         # rounds after which messages that swing are taken as they are
EDGE_BLOCK = 50_000     # edges whose messages are computed at a time
SKIP_BOUND = 4.0        # bound of a skip potential; two of them stand between two repeats
DECIDE = 0.5            # least marginal of an entity label

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From at sign to at sign: the leftmost match starts with the run of local characters before it,
    and where the domain fails, it fails for every start in that run."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and (c := text[lo - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base matches that pass their checks, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- candidates
_MARK = re.compile(r"[0-9@]")
_SPELLED = re.compile(r"\S+ ?[\[({] ?at ?[\])}] ?\S+", re.I)     # of one token
_BRACKETED = re.compile(r"[\[({] ?at ?[\])}]", re.I)
_AT = re.compile(r"@|at[^a-z]")
_SPACE = re.compile(r"\s")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")
_TRIM = "\"'`,;:!?<>*_|"


@dataclass
class Token:
    start: int
    end: int
    word: str
    linked: bool          # the previous candidate stands directly before
    before: str = ""
    after: str = ""


def _spelled_out(text: str) -> Iterator[tuple[int, int]]:
    """Bracketed "at"s with the tokens on both sides, at most one blank apart; none reaches into the one before."""
    done, n = 0, len(text)
    for m in _BRACKETED.finditer(text):
        if m.start() < done:
            continue
        lo = left = m.start() - (m.start() > done and text[m.start() - 1] == " ")
        while lo > done and not text[lo - 1].isspace():
            lo -= 1
        right = m.end() + (m.end() < n and text[m.end()] == " ")
        stop = _SPACE.search(text, right)
        hi = stop.start() if stop else n
        if lo < left and right < hi:
            yield lo, hi
            done = hi


def candidates(text: str) -> list[Token]:
    """Blank-separated tokens with a digit or at sign, and spelled-out addresses."""
    out: list[Token] = []
    at, n = 0, len(text)
    marks = iter(_MARK.finditer(text))
    spans: list[tuple[int, int]] = []
    for m in marks:
        if m.start() < at:
            continue
        lo = m.start()
        while lo > at and not text[lo - 1].isspace():
            lo -= 1
        stop = _SPACE.search(text, m.end())
        at = stop.start() if stop else n
        spans.append((lo, at))
    more = []
    for lo, hi in _spelled_out(text):
        k = bisect_right(spans, (lo,))
        if not any(a < hi and lo < b for a, b in spans[max(0, k - 1):k + 1]):
            more.append((lo, hi))
    last = -1
    for lo, hi in sorted(spans + more):
        word = text[lo:hi]
        cut = word.rstrip(_TRIM + ".")
        lead = len(cut) - len(cut.lstrip(_TRIM))
        lo, hi = lo + lead, lo + len(cut)
        if hi <= lo:
            continue
        tok = Token(lo, hi, text[lo:hi], last >= 0 and lo - last <= 3 and text[last:lo].strip(_TRIM + ". \n\t") == "")
        left = text[max(0, lo - 40):lo].split()
        right = text[hi:hi + 40].split()
        tok.before, tok.after = (left[-1].lower() if left else ""), (right[0].lower() if right else "")
        out.append(tok)
        last = hi
    return out


def shape(word: str) -> str:
    """Letters and digits by class; runs of one class keep their length up to 4."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", word))
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1+", s)[:40]


def features(tok: Token) -> list[str]:
    word = tok.word
    digits = len(_NO_DIGIT.sub("", word))
    groups = [len(g) for g in _DIGITS.findall(word)]
    out = [f"shape={shape(word)}", f"digits={min(digits, 20)}", f"groups={len(groups)}",
           f"separators={''.join(sorted(set(re.sub(r'[^\W_]', '', word))))[:6]}",
           f"letters={bool(_LETTERS.search(word))}", f"first={word[0] if not word[0].isalnum() else 'x'}"]
    if "@" in word or _SPELLED.fullmatch(word):
        out.append("address")
        low = word.lower()
        out.append(f"dots after at={min(3, low.count('.', max((m.end() for m in _AT.finditer(low)), default=0)))}")
    if groups == [3, 3, 4] or groups[-2:] == [3, 4]:
        out.append("phone tail")
    if len(groups) == 4 and max(groups) <= 3 and "." in word:
        out.append("quad" if all(int(g) <= 255 for g in _DIGITS.findall(word)) else "bad quad")
    if 12 <= digits <= 19:
        out.append("luhn" if luhn(_NO_DIGIT.sub("", word)) else "no luhn")
    if tok.before:
        out.append(f"before={_LETTERS.sub('a', tok.before)[:6] if any(c.isdigit() for c in tok.before) else ''}")
    return out


def repeats(tokens: list[Token]) -> list[tuple[int, ...]]:
    """The groups, of two tokens or more, that share a form or the last seven digits; equal groups count once."""
    groups: dict[tuple[str, str], list[int]] = {}
    for i, tok in enumerate(tokens):
        groups.setdefault(("form", tok.word.lower()), []).append(i)
        digits = _NO_DIGIT.sub("", tok.word)
        if len(digits) >= 7:
            groups.setdefault(("digits", digits[-7:]), []).append(i)
    return list(dict.fromkeys(tuple(g) for g in groups.values() if len(g) > 1))


@dataclass
class Field:
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    chain: np.ndarray     # log potential of neighbouring labels
    skip: np.ndarray      # log potential of a token's label and its hub's

    def nodes(self, tokens: list[Token], observed: dict[int, int]) -> np.ndarray:
        """Log potential of each token's labels; an observed token has its label alone."""
        node = np.tile(self.bias, (len(tokens), 1))
        for i, tok in enumerate(tokens):
            if (label := observed.get(i)) is not None:
                node[i] = np.where(np.arange(len(LABELS)) == label, 0.0, -50.0)
                continue
            for f in features(tok):
                if (w := self.weights.get(f)) is not None:
                    node[i] += w
        return node

    def marginals(self, tokens: list[Token], observed: dict[int, int] | None = None) -> np.ndarray:
        """Label marginals of the tokens, given the labels of the ``observed`` ones by index."""
        n, groups = len(tokens), repeats(tokens)
        node = self.nodes(tokens, observed or {})
        right = np.array([i for i, tok in enumerate(tokens) if tok.linked and i], dtype=np.int64)
        member = np.array([i for g in groups for i in g], dtype=np.int64)
        hub = np.repeat(np.arange(n, n + len(groups)), [len(g) for g in groups]).astype(np.int64)
        if not len(right) and not len(member):
            return _softmax(node)
        node = np.vstack([node, np.zeros((len(groups), len(LABELS)))])
        sides = [(right - 1, right, self.chain), (member, hub, self.skip)]
        fwd = [np.zeros((len(a), len(LABELS))) for a, _, _ in sides]
        back = [f.copy() for f in fwd]
        for _ in range(BP_ROUNDS):
            belief, change = node.copy(), 0.0
            for (a, b, _), f, r in zip(sides, fwd, back):
                np.add.at(belief, b, f)
                np.add.at(belief, a, r)
            for s, (a, b, pot) in enumerate(sides):
                if len(a):
                    new_fwd, new_back = _message(belief[a] - back[s], pot), _message(belief[b] - fwd[s], pot.T)
                    change = max(change, np.abs(new_fwd - fwd[s]).max(), np.abs(new_back - back[s]).max())
                    fwd[s], back[s] = 0.5 * (fwd[s] + new_fwd), 0.5 * (back[s] + new_back)
            if change < SETTLED:
                break
        for (a, b, _), f, r in zip(sides, fwd, back):
            np.add.at(node, b, f)
            np.add.at(node, a, r)
        return _softmax(node[:n])


def _message(belief: np.ndarray, pot: np.ndarray) -> np.ndarray:
    """Log messages along edges whose first ends have ``belief``, the greatest entry of each 0."""
    out = np.empty_like(belief)
    for at in range(0, len(belief), EDGE_BLOCK):
        x = belief[at:at + EDGE_BLOCK, :, None] + pot
        top = x.max(axis=1, keepdims=True)
        s = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
        out[at:at + EDGE_BLOCK] = s - s.max(axis=1, keepdims=True)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def base_labels(tokens: list[Token], spans: list[tuple[int, int, int]]) -> list[int]:
    """Label of the first span over each token, 0 without one; both lists are sorted by start. Spans of one
    kind are disjoint, so those that end before a token are passed for good."""
    out, first = [], 0
    for tok in tokens:
        while first < len(spans) and spans[first][2] <= tok.start:
            first += 1
        k = first
        while k < len(spans) and spans[k][0] < tok.end and spans[k][2] <= tok.start:
            k += 1
        out.append(spans[k][1] + 1 if k < len(spans) and spans[k][0] < tok.end else 0)
    return out


TRAIN_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("label", T.IntegerType()),
    T.StructField("pair", T.StringType()), T.StructField("other", T.IntegerType()), T.StructField("n", T.LongType())])


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (features, label) and of labels along chain and skip edges, merged over the task."""
    from collections import Counter
    enter("pii")
    seen: Counter = Counter()
    for b in batches:
        for text in b["text"]:
            tokens = candidates(text)
            if not tokens:
                continue
            y = base_labels(tokens, base_spans(text))
            for tok, lab in zip(tokens, y):
                seen["\x1f".join(features(tok)), lab, "node", 0] += 1
            for i, tok in enumerate(tokens):
                if i and tok.linked:
                    seen["", y[i - 1], "chain", y[i]] += 1
            for group in repeats(tokens):
                for i, j in zip(group, group[1:]):
                    seen["", y[i], "skip", y[j]] += 1
    if seen:
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feature", "label", "pair", "other", "n"])


def _ratio(table: np.ndarray, bound: float = 2.0) -> np.ndarray:
    """Log of observed over independent co-occurrence, smoothed and bounded."""
    t = table + table.T + 0.5
    p = t / t.sum()
    m = p.sum(axis=0)
    return np.clip(np.log(p / np.outer(m, m)), -bound, bound)


def train_field(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit the field on about ``sample_docs`` documents, chosen by a hash of id and text."""
    rows = docs.count()
    share = min(1.0, sample_docs / max(rows, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1e6))
    got = (chosen.mapInPandas(_observe, TRAIN_SCHEMA).groupBy("feature", "label", "pair", "other")
           .agg(F.sum("n").alias("n")).toPandas())
    k = len(LABELS)
    chain, skip = np.zeros((k, k)), np.zeros((k, k))
    for r in got[got["pair"] != "node"].itertuples():
        (chain if r.pair == "chain" else skip)[r.label, r.other] += r.n
    nodes = got[got["pair"] == "node"].sort_values(["feature", "label"])
    names = sorted({f for row in nodes["feature"] for f in row.split("\x1f")})
    index = {f: i for i, f in enumerate(names)}
    w, bias = np.zeros((len(names), k)), np.zeros(k)
    if len(nodes):
        ids = [np.array([index[f] for f in row.split("\x1f")]) for row in nodes["feature"]]
        flat = np.concatenate(ids)
        row_of = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
        y = np.eye(k)[nodes["label"].to_numpy()]
        n = nodes["n"].to_numpy(float)[:, None]
        total, size = n.sum(), np.zeros_like(w)
        grow = np.zeros(k)
        for _ in range(300):                # Adagrad on the weighted softmax likelihood
            z = np.tile(bias, (len(ids), 1))
            np.add.at(z, row_of, w[flat])
            d = (y - _softmax(z)) * n / total
            g = np.zeros_like(w)
            np.add.at(g, flat, d[row_of])
            g -= 1e-5 * w
            size += g * g
            w += 0.3 * g / np.sqrt(size + 1e-12)
            gb = d.sum(axis=0)
            grow += gb * gb
            bias = bias + 0.3 * gb / np.sqrt(grow + 1e-12)
    else:
        bias[0] = 4.0
    return Field({f: w[i] for f, i in index.items()}, bias, _ratio(chain), np.maximum(_ratio(skip, SKIP_BOUND), 0.0) * np.eye(k))


def field_spans(text: str, model: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field adds to the base spans, neighbouring tokens of one kind joined."""
    tokens = candidates(text)
    if not tokens:
        return []
    labels = base_labels(tokens, base)
    free = [not label for label in labels]
    if not any(free):
        return []
    best = model.marginals(tokens, {i: label for i, label in enumerate(labels) if label})
    out: list[list[int]] = []
    for i, (tok, p) in enumerate(zip(tokens, best)):
        kind = int(p.argmax())
        if not free[i] or kind == 0 or p[kind] < DECIDE:
            continue
        if out and tok.linked and free[i - 1] and out[-1][1] == kind - 1 and out[-1][3] == i - 1:
            out[-1][2:] = [tok.end, i]
        else:
            out.append([tok.start, kind - 1, tok.end, i])
    return [(s, kind, e) for s, kind, e, _ in out]


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in sorted(spans))


SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "spans string, n_added long")


def find_pii(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Spans of every whole text: base spans and those that the field adds."""
    own = texts(docs)
    model = model or train_field(own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("pii")
        for b in batches:
            rows = []
            for text in b["text"]:
                base = base_spans(text)
                added = field_spans(text, model, base)
                counts = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append((*counts, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + added), len(added)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    return own.mapInPandas(run, SCHEMA)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are merged
    under the kind of the first."""
    out, at = [], 0
    for s, kind, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind]}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def masked_texts(model: Field):
    """A column function: texts with every base and added span masked; null stays null."""
    @F.pandas_udf(T.StringType())
    def run(column: pd.Series) -> pd.Series:
        enter("pii")

        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            added = field_spans(text, model, base)
            return mask(text, base + added) if base or added else text
        return column.map(one, na_action="ignore")
    return run


def masked(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every found span masked."""
    own = docs.select(F.struct("*").alias("row"), masked_texts(train_field(texts(docs)))(
        F.col("text").cast("string")).alias("masked"))
    return with_text(own, F.col("masked"), docs)
