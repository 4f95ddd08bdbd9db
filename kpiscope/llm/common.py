"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.session import materialize, ship_package

# every byte that is no word character becomes a blank, A-Z become a-z;
# bytes from 0x80 on are word characters
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


_running = ""
_caches: list[Callable[[], None]] = []


def on_change(clear: Callable[[], None]) -> None:
    """Register what drops an operator's cache when its worker turns to another operator."""
    _caches.append(clear)


def enter(operator: str) -> None:
    """Called by an operator's tasks. Workers outlive stages; what the operator before has cached
    or left to the allocators is given back, so memory does not add up along a pipeline."""
    global _running
    if _running == operator:
        return
    if _running:
        for clear in _caches:
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _running = operator


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder; what follows runs Python on executors, which get this package here."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_words(text: str) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split()


def held_out(doc_id: str = "doc_id") -> Column:
    """True for one fifth of the ids; such rows never train a model (null id: False)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of a document table; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def training_docs(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id, text, y`` of labelled rows outside the held-out fold.

    Of each class the ``per_class`` ids with the smallest hashes are taken, so a model is fitted
    on at most twice as many rows. That bound is why the chosen ids may be broadcast; the
    documents are read once and only the chosen ones are kept, as a table of their own.
    """
    kept = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
            .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()))
    kept = kept.groupBy("doc_id").agg(F.max("y").alias("y"))
    first, second = (kept.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(per_class)
                     for y in (0, 1))
    return materialize(texts(docs).join(F.broadcast(first.unionByName(second)), "doc_id"), "training-docs")


def with_text(rows: DataFrame, text: Column, docs: DataFrame) -> DataFrame:
    """The documents held in column ``row`` with a new text, and its length in n_chars."""
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's method for a ridge logistic regression; the last weight is the intercept."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) / len(y) + l2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
