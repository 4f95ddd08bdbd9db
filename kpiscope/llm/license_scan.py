"""License scan: Aho-Corasick over identifier tags and notice phrases, with a
shunting-yard evaluation of and / or / with expressions.

Texts are read as words (``ascii_words``) joined by single blanks, so line
breaks and punctuation inside a notice do not matter. One automaton holds the
notice phrases, the short identifiers that may follow a tag and the tag itself.
Licences that stand next to each other with only ``and``, ``or`` or ``with``
between them form an expression, and so do the identifiers after a tag;
parentheses count there. The value of an expression is its restriction: ``or``
takes the freer side, ``and`` the stricter one, ``with`` softens the licence by
its exception.

Defined cases: a null or empty text has no words, labels '' and score 0.
Every row is judged alone, so repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from kpiscope.llm.common import ascii_words, texts

# ---- fixed values: phrases of the contract and the licences known here ----
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "under the mit license": "mit",
    "mit license": "mit",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license version 2 0": "mpl-2.0",
    "mozilla public license 2 0": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl-3.0",
    "gnu affero general public license": "agpl-3.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "creative commons attribution": "cc-by-4.0",
    "creative commons zero": "cc0-1.0",
    "cc0 1 0": "cc0-1.0",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG_IDENTIFIERS = {
    "apache-2.0": 0.2, "mit": 0.1, "bsd-2-clause": 0.1, "bsd-3-clause": 0.1, "isc": 0.1,
    "mpl-2.0": 0.5, "epl-2.0": 0.5, "lgpl-2.1": 0.5, "lgpl-3.0": 0.5,
    "gpl-2.0": 0.7, "gpl-3.0": 0.7, "gpl-2.0-only": 0.7, "gpl-2.0-or-later": 0.7,
    "gpl-3.0-only": 0.7, "gpl-3.0-or-later": 0.7, "agpl-3.0": 0.8,
    "cc0-1.0": 0.05, "cc-by-4.0": 0.2, "cc-by-sa-4.0": 0.5, "cc-by-nc-4.0": 0.9, "cc-by-nd-4.0": 0.9,
    "public-domain": 0.0, "reserved": 1.0,
}
BASE_RESTRICTION = {"cc-by": 0.2, "gpl": 0.7, "reserved": 1.0}
EXCEPTIONS = {"classpath-exception-2.0": 0.3, "gcc-exception-3.1": 0.3, "llvm-exception": 0.1}
TAG = "spdx license identifier"
# ---- end of fixed values ----

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
UNKNOWN_RESTRICTION = 0.6


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix tokens to postfix order; None if they form no expression."""
    out: list[str] = []
    ops: list[str] = []
    operand_due = True
    for tok in tokens:
        if tok == "(":
            if not operand_due:
                return None
            ops.append(tok)
        elif tok == ")":
            if operand_due:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif tok in PRECEDENCE:
            if operand_due:
                return None
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[tok]:
                out.append(ops.pop())
            ops.append(tok)
            operand_due = True
        else:
            if not operand_due:
                return None
            out.append(tok)
            operand_due = False
    if operand_due or "(" in ops:
        return None
    return out + ops[::-1]


def longest_expression(tokens: list[str]) -> list[str]:
    """The longest beginning of the tokens that is an expression; prose may follow it."""
    depth, operand_due, size = 0, True, 0
    for i, tok in enumerate(tokens):
        if tok == "(" or tok not in PRECEDENCE and tok != ")":
            if not operand_due:
                break
            depth += tok == "("
            operand_due = tok == "("
        else:
            if operand_due or tok == ")" and not depth:
                break
            depth -= tok == ")"
            operand_due = tok != ")"
        if not operand_due and not depth:
            size = i + 1
    return tokens[:size]


def restriction(postfix: list[str]) -> float:
    """Value of a postfix expression in 0..1."""
    stack: list[tuple[float, str]] = []
    for tok in postfix:
        if tok not in PRECEDENCE:
            stack.append((TAG_IDENTIFIERS.get(tok, BASE_RESTRICTION.get(tok, UNKNOWN_RESTRICTION)), tok))
            continue
        (right, name), (left, _) = stack.pop(), stack.pop()
        value = min(left, right) if tok == "or" else max(left, right) if tok == "and" \
            else max(0.0, left - EXCEPTIONS.get(name, 0.0))
        stack.append((value, ""))
    return stack[0][0]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, label))
    for ident in TAG_IDENTIFIERS:
        spelled = " ".join(re.findall("[a-z0-9]+", ident))
        if " " in spelled and f" {spelled} " not in a:
            a.add_word(f" {spelled} ", (len(spelled) + 2, ident))
    a.add_word(f" {TAG} ", (len(TAG) + 2, TAG))
    a.make_automaton()
    return a


TAG_LINE = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)")
EXPRESSION_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")


def _tag_expressions(text: str) -> Iterator[list[str]]:
    for m in TAG_LINE.finditer(text):
        tokens = [t.lower().rstrip(".+") or t for t in EXPRESSION_TOKEN.findall(m[1])]
        if tokens := longest_expression(tokens):
            yield to_postfix(tokens)


def _notices(line: str) -> tuple[list[tuple[int, int, str]], bool]:
    """(start, end, label) of the notices in a line of words, longest first at a place; whether it holds a tag."""
    found, tagged = [], False
    for end, (size, label) in _automaton().iter(line):
        if label == TAG:
            tagged = True
        else:
            found.append((end - size + 1, end, label))
    return sorted(found, key=lambda m: (m[0], -m[1])), tagged


def scan(text: str) -> tuple:
    """One text: n_words, n_base, first_word, last_word, base labels, labels, score."""
    words = ascii_words(text)
    line = f" {b' '.join(words).decode('utf-8')} "
    base: set[str] = set()
    n_base, first, last = 0, None, None
    for phrase, label in BASE_PHRASES.items():
        at, counted, word = line.find(f" {phrase} "), 0, 0
        while at >= 0:
            n_base += 1
            base.add(label)
            word += line.count(" ", counted, at)
            counted = at
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
            at = line.find(f" {phrase} ", at + 1)
    found, tagged = _notices(line)
    if tagged:                              # what a tag names is read as its expression, not as notices
        line = f" {b' '.join(ascii_words(TAG_LINE.sub(chr(10), text))).decode('utf-8')} "
        found, _ = _notices(line)
    labels, score = set(base), max((BASE_RESTRICTION[b] for b in base), default=0.0)
    chain: list[str] = []
    reach, values = -1, []
    for start, end, label in found:
        if end <= reach:
            continue                        # inside a longer notice
        between = line[reach:start + 1].strip() if chain else ""
        if chain and between in PRECEDENCE and start >= reach:
            chain += [between, label]
        else:
            if chain:
                values.append(chain)
            chain = [label]
        reach = end
        labels.add(label)
    if chain:
        values.append(chain)
    postfixes = [rpn for tokens in values if (rpn := to_postfix(tokens))]
    if tagged:
        for rpn in _tag_expressions(text):
            labels.update(t for t in rpn if t not in PRECEDENCE and t not in EXCEPTIONS)
            postfixes.append(rpn)
    score = max([score, *map(restriction, postfixes)])
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double")


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence evidence of every whole text; one row per input row."""
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([scan(t) for t in b["text"]], columns=names)
            out["first_word"] = out["first_word"].astype("Int64")
            out["last_word"] = out["last_word"].astype("Int64")
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    return texts(docs).mapInPandas(run, SCHEMA)
