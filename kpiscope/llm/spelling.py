"""Spelling variants grouped by reduced-alphabet generation.

Words and their counts come from one aggregate over the documents. Every letter is then hashed to
one of a few symbols, balanced by how often letters occur, so that no symbol is much commoner than
another. A word's key is a rolling hash of its reduced form. Two words one edit apart have reduced
forms at most one edit apart; so each word generates the full one-edit neighbourhood of its reduced
form (deletions, replacements, insertions and the form itself) as keys, all words of one length in
one matrix. Keys that occur in the reduced vocabulary are joined to it, and every joined pair is
verified on the original strings.

Most generated keys are no word's key. A Bloom filter over the vocabulary's keys drops them inside
the generating task. It holds ``BITS_PER_WORD`` bits a word and ``MAX_BITS`` at most (32 MB); above that
size it only prunes less. No pair is lost through it, since a filter has no false negatives.

Forms chain upwards (each at least ``FACTOR`` times as frequent as the one before), so pointer doubling
finds all roots in as many rounds as log2 of the longest chain.

Defined cases: a null text has no words; the number of a null doc_id is the empty text in the hashed
string. Repeated rows count as often as they occur. An empty table gives an empty result. Runs of any
length are words. Equal counts go by code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.common import enter
from kpiscope.session import materialize

MIN_LETTERS = 7
MIN_COUNT = 2
DAMAGE = 31             # fixed by the contract: one run in so many loses a letter
FACTOR = 10             # a form is at least so many times as frequent
SYMBOLS = 12            # symbols of the reduced alphabet
BITS_PER_WORD = 64
MAX_BITS = 2 ** 28
SLICE_BITS = 2 ** 19    # bits of the filter that one group builds
CELLS = 500_000         # keys of one matrix of neighbourhoods, at most about
SHORT = 64              # longer words are compared by their first difference
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------------- words
def lower_ascii(run: Column) -> Column:
    """A-Z lower-cased; other letters keep their case."""
    return F.when(run.rlike("[^A-Za-z]"), F.translate(run, UPPER, LOWER)).otherwise(F.lower(run))


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that occur often enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{LETTERS}{{{min_letters},}}"), F.lit(0))).alias("run"))
    run, h, size = F.col("run"), F.col("h"), F.length("run")
    runs = runs.select("id", lower_ascii(run).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (h % size).cast("int")
    word = F.when(h % DAMAGE == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, size))).otherwise(run)
    return (runs.select(word.alias("word")).where(F.length("word") >= min_letters)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


# --------------------------------------------------------- reduced alphabet
def reduced_alphabet(words: DataFrame, symbols: int = SYMBOLS) -> dict[str, int]:
    """Letter -> symbol 1..symbols: the commonest letters first, each to the least used symbol.

    The letters are those of ``LETTERS``, so the driver gets about a hundred rows at most.
    """
    rows = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect()
    load, chosen = [0] * symbols, {}
    for r in sorted((r for r in rows if r["c"]), key=lambda r: (-r["count"], r["c"])):
        least = load.index(min(load))
        load[least] += r["count"]
        chosen[r["c"]] = least + 1
    return chosen


_BASE = 0x9E3779B97F4A7C15      # odd, so all arithmetic modulo 2^64 keeps its bits


class Neighbourhoods:
    """Keys of reduced words and of their one-edit neighbourhoods, a matrix of equal lengths at a time."""

    def __init__(self, alphabet: dict[str, int], symbols: int):
        self.symbol = np.zeros(0x110000 if not alphabet else max(map(ord, alphabet)) + 1, np.uint64)
        for c, s in alphabet.items():
            self.symbol[ord(c)] = s
        self.symbols = symbols

    def reduced(self, words: list[str]) -> np.ndarray:
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        return self.symbol[points]

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        """base^0 .. base^(n-1) modulo 2^64."""
        steps = np.full(n, _BASE, np.uint64)
        steps[:1] = 1
        return np.multiply.accumulate(steps)

    def _prefixes(self, s: np.ndarray) -> np.ndarray:
        """Row p holds the key of each word's first p symbols."""
        keys, base = np.zeros((s.shape[1] + 1, len(s)), np.uint64), np.uint64(_BASE)
        for i in range(s.shape[1]):
            keys[i + 1] = keys[i] * base + s[:, i]
        return keys

    def keys(self, words: list[str]) -> np.ndarray:
        """The key of each reduced word; words of one length."""
        return self._prefixes(self.reduced(words))[-1]

    def around(self, words: list[str]) -> Iterator[np.ndarray]:
        """Keys of every reduced word itself and of all its one-edit neighbours: matrices with a column for each word."""
        s = self.reduced(words)
        n, base = s.shape[1], np.uint64(_BASE)
        power = self._powers(n + 1)[::-1, None]                  # row p: base^(n - p)
        pre = self._prefixes(s)
        yield pre[n:]
        shifted = pre * base
        after = pre[n] - pre * power                             # key of the symbols from p on
        for symbol in range(1, self.symbols + 1):
            yield (shifted + np.uint64(symbol)) * power + after                     # inserted before p
        yield pre[:-1] * power[1:] + after[1:]                                      # p deleted
        for symbol in range(1, self.symbols + 1):
            yield (shifted[:-1] + np.uint64(symbol)) * power[1:] + after[1:]        # p replaced


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def filter_places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a Bloom filter of so many bits (a power of two)."""
    mask = np.uint64(bits - 1)
    return _mixed(keys, 0x1234567) & mask, _mixed(keys, 0x89ABCDE) & mask


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        yield n, np.flatnonzero(lengths == n)


def keyed_words(words: DataFrame, alphabet: dict[str, int], symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, key``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        make = Neighbourhoods(alphabet, symbols)
        for b in batches:
            found = b["word"].to_pylist()
            keys = np.zeros(len(found), np.uint64)
            for _, at in _by_length(found):
                keys[at] = make.keys([found[i] for i in at])
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], pa.array(keys.view(np.int64))], names=["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def bloom_filter(keyed: DataFrame, words: int, bits_per_word: int = BITS_PER_WORD, max_bits: int = MAX_BITS) -> np.ndarray:
    """The filter's bits, eight to a byte; slices of it are built by groups of bounded size."""
    bits = min(max_bits, max(SLICE_BITS, 1 << (bits_per_word * words - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        for b in batches:
            at = np.unique(np.concatenate(filter_places(b["key"].to_numpy().view(np.uint64), bits))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // SLICE_BITS), pa.array(at % SLICE_BITS)], names=["slice", "at"])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        held = np.zeros(SLICE_BITS, bool)
        held[table["at"].to_numpy()] = True
        return pa.table({"slice": [key[0].as_py()], "bits": [np.packbits(held, bitorder="little").tobytes()]})

    slices = (keyed.select("key").mapInArrow(places, "slice long, at long").distinct()
              .groupBy("slice").applyInArrow(build, "slice long, bits binary"))
    whole = np.zeros((bits // SLICE_BITS, SLICE_BITS // 8), np.uint8)
    for r in slices.toLocalIterator():
        whole[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.reshape(-1)


def candidate_keys(keyed: DataFrame, alphabet: dict[str, int], held: np.ndarray, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, key``: neighbourhood keys that the filter lets through, each once for a word."""
    sent = keyed.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        make, bloom = Neighbourhoods(alphabet, symbols), sent.value
        bits = len(bloom) * 8

        def let_through(keys: np.ndarray) -> np.ndarray:
            ok = np.arange(len(keys))
            for at in filter_places(keys, bits):        # the second place only of keys that pass the first
                at = at[ok]
                ok = ok[bloom[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
            return ok

        for b in batches:
            words = b["word"].to_pylist()
            for n, places in _by_length(words):
                step = max(1, CELLS // (n + 1))
                for lo in range(0, len(places), step):
                    at = places[lo:lo + step]
                    rows, keys = [], []
                    for matrix in make.around([words[i] for i in at]):
                        flat = matrix.reshape(-1)
                        ok = let_through(flat)
                        rows.append(at[ok % len(at)])
                        keys.append(flat[ok])
                    found = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(keys)], names="row,key"))
                    row = pa.array(found["row"])
                    yield pa.RecordBatch.from_arrays([b["word"].take(row), b["n"].take(row), pa.array(found["key"].view(np.int64))],
                                                     names=["word", "n", "key"])

    return keyed.mapInArrow(run, "word string, n long, key long")


# ---------------------------------------------------------------------- forms
def one_edit(a: Column, b: Column) -> Column:
    """Exactly one code point inserted, deleted or replaced; linear in long words, where levenshtein is not."""
    long_a, long_b = F.length(a), F.length(b)
    first = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")

    def rest(word: Column, skipped: Column) -> Column:
        return word.substr(first + skipped.cast("int"), F.length(word))

    linear = (first > 0) & (F.abs(long_a - long_b) <= 1) & (rest(a, long_a >= long_b) == rest(b, long_b >= long_a))
    return F.when(F.greatest(long_a, long_b) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(linear)


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words one edit apart."""
    alphabet = reduced_alphabet(words, symbols)
    keyed = materialize(keyed_words(words, alphabet, symbols), "spelling-keys")
    held = bloom_filter(keyed, max(1, keyed.count()))
    near = keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    return (candidate_keys(keyed, alphabet, held, symbols).join(near, "key")
            .where(one_edit(F.col("word"), F.col("near"))).select("word", "n", "near", "near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for words that have a form, by pointer doubling."""
    reach = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(reach.join(further, "root", "left")
                           .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                           "spelling-roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        reach = step.select("word", "root")


def variants(docs: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = materialize(word_counts(docs), "spelling-words")
    strong = F.col("near_n") >= F.lit(FACTOR) * F.col("n")
    best = F.min(F.when(strong, F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))))
    near = near_words(words, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = materialize(words.join(near, "word", "left").select(
        "word", F.col("best.form").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        (-F.col("best.minus")).alias("form_n")), "spelling-forms")
    roots = _roots(found.where(F.col("form").isNotNull()).select("word", "form"))
    return (found.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
