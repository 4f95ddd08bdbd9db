"""Benchmark decontamination through an FM-index of each training shard.

Texts are words (``ascii_words``). The test phrases are all windows of ``window``
consecutive words of an item, or the whole item if it is shorter. They are the
stated query set: their blocks, each of bounded size, meet all documents.

A shard is a run of documents of bounded size inside a task. Its words become
numbers of the block's vocabulary. A word of no test phrase ends a phrase
wherever it stands, so it acts as a separator, and a stretch between separators
that is shorter than the shortest phrase holds no occurrence; the index holds
all other stretches whole. Suffixes are sorted in full by prefix doubling, the
Burrows-Wheeler transform is kept as a wavelet matrix with rank directories,
and suffix positions are sampled within each stretch. All phrases step through
the backward search together; rows of non-empty ranges walk back by
last-to-first steps to a sampled position. Occurrences are mapped to documents
and their word intervals merged to removal spans.

Defined cases: a null or empty text has no words, no hits and the digest of the
empty list. Repeated documents give repeated results; repeated items count by
item_id; an item without words is no phrase; an item without an id can hit words
but is not listed. Without items nothing is contaminated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiscope.llm.common import WORD_BYTES, ascii_words, enter, texts, with_text

WINDOW = 10
SHARD_CHARS = 4_000_000      # characters of a training shard, about (a longer text is a shard alone)
BLOCK_CHARS = 4_000_000      # characters of test items in one block
SAMPLE_EVERY = 8             # one suffix position in so many is kept
SEPARATOR = 0


# ------------------------------------------------------------------ the index
class Wavelet:
    """Wavelet matrix over small integers: ranks of a symbol in prefixes, for many at once."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position end[i]."""
        lo, hi = np.zeros_like(end), end.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(up, zeros + lo1, lo - lo1)
            hi = np.where(up, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols at the positions."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes; separators are ordered by position, which bounds common prefixes
    by the longest stretch. Prefix doubling; only rows still tied are sorted again."""
    n = len(seq)
    is_sep = seq == SEPARATOR
    n_sep = int(is_sep.sum())
    rank = np.where(is_sep, np.cumsum(is_sep) - 1, seq.astype(np.int64) + n_sep)
    span = 1
    width = int(rank.max(initial=0)) + 2
    wide = rank + 1
    key = wide.copy()
    while span < n and int(key.max(initial=0)) < (1 << 62) // width:      # pack as many words as fit
        key = key * width + np.concatenate([wide[span:], np.zeros(min(span, n), np.int64)])
        span += 1
    order = np.argsort(key, kind="stable")
    rank = _ranks(key[order], order)
    while True:
        sizes = np.bincount(rank, minlength=n + 1)
        open_rows = order[sizes[rank[order]] > 1]
        if not len(open_rows):
            return order
        ahead = np.minimum(open_rows + span, n)
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[open_rows] * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        slots = np.flatnonzero(sizes[rank[order]] > 1)
        rows, keys = open_rows[by], key[by]
        order[slots] = rows
        new_group = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[rows] = slots[np.maximum.accumulate(np.where(new_group, np.arange(len(rows)), 0))]
        span *= 2


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each row: position of the first equal key in sorted order."""
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return rank


class FMIndex:
    """Backward search and location over a text of words and separators (0); it ends with one."""

    def __init__(self, seq: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        order = suffix_array(seq)
        self.n = len(seq)
        self.bwt = Wavelet(seq[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))]).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(seq == SEPARATOR) + 1])
        inside = np.arange(self.n) - np.repeat(starts, np.diff(np.append(starts, self.n)))
        kept = (inside % every == 0)[order]
        self.kept = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, given as right-aligned rows of word numbers."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(hi[live] > lo[live])]
            go = live[sizes[live] > step]
            if not len(go):
                break
            symbol = phrases[go, phrases.shape[1] - 1 - step].astype(np.int64)
            lo[go] = self.first[symbol] + self.bwt.rank(symbol, lo[go])
            hi[go] = self.first[symbol] + self.bwt.rank(symbol, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            kept = self.kept[at + 1] > self.kept[at]
            done = open_[kept]
            out[done] = self.positions[self.kept[at[kept]]] + steps[done]
            open_, at = open_[~kept], at[~kept]
            symbol = self.bwt.access(at)
            at = self.first[symbol] + self.bwt.rank(symbol, at)
            steps[open_] += 1
        return out


# ---------------------------------------------------------------- test phrases
@dataclass
class Phrases:
    """One block of test items: vocabulary, distinct windows and the items that hold each."""

    vocabulary: dict[bytes, int]
    rows: np.ndarray            # right-aligned word numbers
    sizes: np.ndarray
    items: list[tuple[str, ...]]

    @property
    def shortest(self) -> int:
        return int(self.sizes.min(initial=WINDOW))


def phrases_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        words = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ascii_words(text or "")]
        for at in range(max(1, len(words) - window + 1) if words else 0):
            held = holders.setdefault(tuple(words[at:at + window]), set())
            if item_id is not None:
                held.add(item_id)
    rows = np.zeros((len(holders), window), np.int32)
    for i, w in enumerate(holders):
        rows[i, window - len(w):] = w
    return Phrases(vocabulary, rows, np.array([len(w) for w in holders], np.int64),
                   [tuple(sorted(h)) for h in holders.values()])


def shard_hits(words: list[list[bytes]], block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, phrase) of every occurrence in a shard of documents."""
    none = np.zeros(0, np.int64)
    if not len(block.sizes):
        return none, none, none
    number, lengths = block.vocabulary.get, np.array([len(w) for w in words], np.int64)
    total = int(lengths.sum()) + len(words)
    seq = np.zeros(total, np.int32)
    ends = np.cumsum(lengths + 1)
    for w, end in zip(words, ends.tolist()):
        seq[end - 1 - len(w):end - 1] = [number(x, SEPARATOR) for x in w]
    cuts = np.flatnonzero(seq == SEPARATOR)
    runs = np.diff(cuts, prepend=-1) - 1
    long_ = runs >= block.shortest
    if not long_.any():
        return none, none, none
    run_end, run_size = cuts[long_], runs[long_] + 1            # with the separator that ends it
    packed_end = np.cumsum(run_size)
    shift = run_end - (packed_end - 1)
    source = np.arange(int(packed_end[-1])) + np.repeat(shift, run_size)
    index = FMIndex(seq[source], len(block.vocabulary) + 1)
    lo, hi = index.search(block.rows, block.sizes)
    counts = np.maximum(hi - lo, 0)
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
    place = source[index.locate(rows)]
    doc = np.searchsorted(ends, place, side="right")
    return doc, place - (ends[doc] - lengths[doc] - 1), phrase


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals, as sorted disjoint ones; touching intervals join."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


# -------------------------------------------------------------------- operator
LEAKS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("clean", T.StringType())])


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """Test items in blocks of about ``block_chars`` characters, dealt by a hash; one block at a
    time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text") + 40), F.lit(0))).first()[0]
    n = max(1, -(-size // block_chars))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] or "", r[1]))


def shard_leaks(docs: list[str], blocks: list) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, merged spans, items) of each text of a shard, over all blocks of test phrases."""
    words = [ascii_words(t) for t in docs]
    found: dict[int, tuple[list, list, set]] = {}
    for shared in blocks:
        block = shared.value
        doc, first, phrase = shard_hits(words, block)
        by = np.argsort(doc, kind="stable")
        doc, first, phrase = doc[by], first[by], phrase[by]
        for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
            if len(part):
                starts, ends, items = found.setdefault(int(doc[part[0]]), ([], [], set()))
                starts.append(first[part])
                ends.append(first[part] + block.sizes[phrase[part]])
                items.update(*(block.items[p] for p in np.unique(phrase[part])))
    for i, w in enumerate(words):
        if i in found:
            starts, ends, items = found[i]
            yield len(w), merged(np.concatenate(starts), np.concatenate(ends)), sorted(items)
        else:
            yield len(w), [], []


def leak_column(benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS,
                block_chars: int = BLOCK_CHARS, cleaned: bool = False):
    """A column function of texts: their words, merged word intervals and items, and, if asked for,
    the text without those intervals (null where there are none)."""
    context = benchmark.sparkSession.sparkContext
    blocks = [context.broadcast(phrases_of(b, window)) for b in _blocks(benchmark, block_chars)]

    @F.pandas_udf(LEAKS)
    def run(column: pd.Series) -> pd.DataFrame:
        enter("decontamination")
        texts_ = [t or "" for t in column]
        shard_of = np.cumsum([len(t) for t in texts_]) // shard_chars
        rows = []
        for part in np.split(np.arange(len(texts_)), np.flatnonzero(np.diff(shard_of)) + 1):
            own = [texts_[i] for i in part]
            for text, (n, spans, items) in zip(own, shard_leaks(own, blocks)):
                rows.append((n, [{"first": a, "after": b} for a, b in spans], items,
                             without_spans(text, spans) if cleaned and spans else None))
        return pd.DataFrame(rows, columns=LEAKS.names)

    return run


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words, hits, items and their digest for every row."""
    own = texts(docs)
    found = own.select("doc_id", leak_column(benchmark, window)("text").alias("leak"))
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return found.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with test passages cut out of their texts; a document that
    holds nothing else goes."""
    found = docs.select(F.struct("*").alias("row"), leak_column(benchmark, window, cleaned=True)(
        F.col("text").cast("string")).alias("leak"))
    clean = F.col("leak.clean")
    left = F.length(F.regexp_replace(clean, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "")) > 0
    return with_text(found.where(clean.isNull() | left), F.coalesce(clean, F.col("row.text")), docs)


def word_places(text: str) -> list[tuple[int, int]]:
    """Code-point interval of each word of ``ascii_words``."""
    raw = text.encode("utf-8", "replace")
    mask = np.frombuffer(raw.translate(WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return list(zip(chars[edges[::2]].tolist(), chars[edges[1::2]].tolist()))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; other text is as it was."""
    places = word_places(text)
    out, at = [], 0
    for first, after in spans:
        out.append(text[at:places[first][0]])
        at = places[after - 1][1]
    return "".join(out) + text[at:]
