"""Ranked lexical search in reverse: items wait in an index, documents stream by.

The items' terms form an inverted index (term -> items). It goes to every task in blocks of at most
``INDEX_BYTES``, so a broadcast is bounded however many items there are. Each document's terms are
counted once, and only the counts of terms in the index are kept: ``n`` and two short arrays a
document, written as a table. Its sums give the corpus figures (documents, terms, document
frequencies; partial sums before the exchange). Then every document's counts stream through the
index; each task holds a heap of the best ``k`` documents for each item, entered only by scores that
beat its smallest. Heaps are merged in two steps, first salted, then by item, so no task meets the
heaps of all tasks.

Arithmetic is that of the contract: weights in doubles, the rest in 64-bit integers.

Defined cases: a null text or item has no terms. Documents without a term rank nowhere; items
without a known term have no rows. Rows that repeat a document are ranked each by itself; equal
scores go by doc_id, null ids last. Rows that repeat an item_id with the same text count as one
item; with different texts, as an item whose terms are those of all its rows. Empty tables give an
empty result. A text is counted whole, whatever its length.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.llm.common import ascii_words, enter, texts
from kpiscope.session import materialize

INDEX_BYTES = 32 * 1024 * 1024      # terms and postings of one block of items
SALTS = 32
DOCS_AT_ONCE = 256

# fixed by the contract
WEIGHT_SCALE = 1000
TF_SCALE = 1_000_000_000
TF_FACTOR, LENGTH_FACTOR = 1000, 8
FLAT, SLOPE, BASE = 10, 90, 100     # m = FLAT + SLOPE * n * N div L


class ItemIndex:
    """Inverted index of one block of items: term -> number, and the items of each term."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.ids = [item for item, _ in items]
        of: dict[bytes, list[int]] = {}
        for at, (_, terms) in enumerate(items):
            for term in terms:
                of.setdefault(term, []).append(at)
        self.number = {term: n for n, term in enumerate(of)}
        lengths = np.array([len(p) for p in of.values()], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.postings = np.array([at for p in of.values() for at in p], np.int64)


def item_blocks(items: DataFrame, max_bytes: int = INDEX_BYTES) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, in blocks of at most about ``max_bytes`` (one item at least).

    The driver holds one block at a time; items stream in, partition by partition.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block: dict[int | None, dict[bytes, None]] = {}
    size = 0
    for r in rows.orderBy("item_id").toLocalIterator():
        terms = dict.fromkeys(ascii_words(r["text"] or ""))
        if r["item_id"] not in block and size + 100 * len(terms) > max_bytes and block:
            yield [(item, list(t)) for item, t in block.items()]
            block, size = {}, 0
        block.setdefault(r["item_id"], {}).update(terms)
        size += sum(len(t) + 100 for t in terms)
    if block:
        yield [(item, list(t)) for item, t in block.items()]


COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])


def term_counts(docs: DataFrame, index) -> DataFrame:
    """``doc_id, n, terms, tfs`` of documents with at least one term; of its terms those in the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("reversed_search")
        number = index.value.number
        for b in batches:
            for at in range(0, len(b), DOCS_AT_ONCE):
                part, rows = b.slice(at, DOCS_AT_ONCE), []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"]):
                    words = ascii_words(text.as_py())
                    if words:
                        found = Counter(words)
                        known = found.keys() & number.keys()
                        rows.append((doc_id, len(words), [number[t] for t in known], [found[t] for t in known]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), COUNTS)], schema=COUNTS)

    return texts(docs).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Heaps:
    """The best k documents of each item so far; the smallest entry is on top.

    Entries order by score, then by smaller id; a null id comes after all others.
    """

    def __init__(self, items: int, k: int):
        self.k, self.entries = k, [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)      # a score below cannot enter

    def offer(self, item: int, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -doc_id if doc_id is not None else 0)
        heap = self.entries[item]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[item] = heap[0][0]


def scores_of(part: pa.RecordBatch, index: ItemIndex, weight: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Scores of some documents for every item, ``documents x items``."""
    m = BASE - SLOPE + (SLOPE * part["n"].to_numpy() * n_docs) // n_terms
    lengths = np.diff(part["terms"].offsets.to_numpy())
    doc = np.repeat(np.arange(len(part)), lengths)
    term = part["terms"].flatten().to_numpy().astype(np.int64)
    tf = part["tfs"].flatten().to_numpy()
    value = weight[term] * ((TF_SCALE * tf) // (TF_FACTOR * tf + LENGTH_FACTOR * m[doc]))
    fan = index.starts[term + 1] - index.starts[term]               # items of each (document, term)
    first = np.cumsum(fan) - fan
    at = np.repeat(index.starts[term] - first, fan) + np.arange(int(fan.sum()))
    scores = np.zeros(len(part) * len(index.ids), np.int64)
    np.add.at(scores, np.repeat(doc * len(index.ids), fan) + index.postings[at], np.repeat(value, fan))
    return scores.reshape(len(part), len(index.ids))


BEST = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("salt", pa.int32())])


def best_of_tasks(counts: DataFrame, index, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The heaps of every task as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enter("reversed_search")
        held = index.value
        heaps = Heaps(len(held.ids), k)
        for b in batches:
            for at in range(0, len(b), DOCS_AT_ONCE):
                part = b.slice(at, DOCS_AT_ONCE)
                scores = scores_of(part, held, weight, n_docs, n_terms)
                ids = part["doc_id"].to_pylist()
                for doc, item in np.argwhere((scores > 0) & (scores >= heaps.least)).tolist():
                    heaps.offer(item, int(scores[doc, item]), ids[doc])
        salt = TaskContext.get().partitionId() % SALTS
        rows = [(held.ids[item], -entry[2] if entry[1] else None, entry[0], salt)
                for item, heap in enumerate(heaps.entries) for entry in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BEST)], schema=BEST)

    return counts.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item_id long, doc_id long, score long, salt int")


def _merged(heaps: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return (heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("rank") <= k))


def search(docs: DataFrame, items: DataFrame, k: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item."""
    spark, found = docs.sparkSession, []
    for block in item_blocks(items, index_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(block))
        counts = materialize(term_counts(docs, index), "reversed-counts")
        totals = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["docs"] or not len(index.value.number):
            continue
        df = np.zeros(len(index.value.number), np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]              # as many rows as the block has terms
        weight = weights(totals["docs"], df)
        heaps = best_of_tasks(counts, index, weight, totals["docs"], totals["terms"], k)
        merged = _merged(_merged(heaps, ["item_id", "salt"], k).drop("rank"), ["item_id"], k)
        found.append(materialize(merged.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"),
                                 "reversed-best"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every
