"""Best-fit decreasing packing into windows, with a segment tree over remaining capacities.

Documents become token ids and an end id. A document longer than a window is first cut into full
windows, which are sequences of their own, and a rest. Rests and short documents are dealt to shards
of bounded size by a number of their row, so that repeated documents spread over all shards. A shard
takes its pieces by decreasing length; a segment tree whose leaves are the remaining capacities
1..capacity holds the open windows, and the leftmost non-empty leaf at or after a piece's length is
the tightest window that takes it (two walks of log2(capacity) steps for each piece).

Windows that best fit leaves under ``POOR_FILL`` are dissolved. Their pieces, pooled over shards, are
laid end to end and cut where a window is full, so many documents of one awkward length cost no
padding either. What remains at the end of a pool is cut at powers of two, which need no padding.

Tokens: byte-level BPE. Texts are encoded by the rank form of the same vocabulary where the folder
has it, which gives the same ids in a quarter of the time (tests compare both); texts that hold a
special token, or a stretch of 1,000 characters without or with nothing but blanks, go through the
tokenizer itself, whose merges are not quadratic in the length of one pre-token.

Defined cases: a null text is empty and gives one piece holding the end id only. Repeated rows and
null ids are packed like any other row, each by itself. An empty table gives an empty result. Texts
of any length are read whole; their ids are held for one document at a time.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.common import enter, on_change, texts
from kpiscope.session import materialize

CAPACITY = 1024
END_ID = 0
SHARD_PIECES = 8192     # pieces of a shard, about
BROADCAST_POOR = 4_000_000      # numbers of pieces in poor windows that are broadcast (8 bytes each); more are joined
POOR_FILL = 0.99        # windows below are dissolved and their pieces cut to fill windows
DOCS_AT_ONCE = 500
STRETCH = 1000          # a stretch so long without a blank, or of blanks, is left to the tokenizer


# --------------------------------------------------------------------- tokens
class ByteTokens:
    """Little-endian 32-bit ids of texts under a byte-level BPE tokenizer file.

    ``<name>.tiktoken`` beside ``<name>.json`` is taken as the same vocabulary in rank form.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"   # fixed by the vocabulary

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.ranks = None
        beside = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(beside):
            import tiktoken
            with open(beside, "rb") as f:
                pairs = [line.split() for line in f.read().splitlines() if line]
            self.ranks = tiktoken.Encoding("ranks", pat_str=self.PATTERN, special_tokens={},
                                           mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs})

    def _plain(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        for at in range(0, len(text) - STRETCH + 1, STRETCH):
            if text.find(" ", at, at + STRETCH) < 0 or text[at:at + STRETCH].isspace():
                return False
        return True

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is not None and self._plain(text):
            return np.array(self.ranks.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=1)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


on_change(byte_tokens.cache_clear)

COLUMNS = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long"}
PIECES = ", ".join(f"{k} {v}" for k, v in COLUMNS.items()) + ", ids binary"
ARROW = pa.schema([(name, pa.int64()) for name in COLUMNS] + [("ids", pa.binary())])


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Full windows and the shorter rest of each whole text; a rest carries its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("window_packing")
        encode = byte_tokens(tokenizer)
        for b in batches:
            for at in range(0, len(b), DOCS_AT_ONCE):
                part, rows = b.slice(at, DOCS_AT_ONCE), []
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"]):
                    ids = np.append(encode(text.as_py()), np.array([END_ID], "<u4")).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start:start + capacity].tobytes()
                        n = len(piece) // 4
                        rows.append((doc_id, start, n, zlib.crc32(piece), len(ids), piece if n < capacity else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)

    return texts(docs).mapInArrow(run, PIECES)


# ------------------------------------------------------------------- best fit
class OpenWindows:
    """Open windows in a segment tree over their remaining capacities 1..capacity.

    A node holds how many windows its leaves hold; ``tightest`` climbs from the leaf of a size
    to the first sibling on the right that is not empty and descends to its leftmost window.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.windows: list[list[int]] = [[] for _ in range(self.width)]

    def _add(self, room: int, by: int) -> None:
        node, count = room + self.width, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, window: int, room: int) -> None:
        if room:
            self.windows[room].append(window)
            self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least ``size``; None when there is none."""
        node, count = size + self.width, self.count
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node <<= 1
                if not count[node]:
                    node += 1
        room = node - self.width
        self._add(room, -1)
        return self.windows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``window, offset`` of each piece; lengths must not increase."""
    tree, opened = OpenWindows(capacity), 0
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        found = tree.tightest(size)
        if found is None:
            found = opened, capacity
            opened += 1
        window[i], offset[i] = found[0], capacity - found[1]
        tree.put(found[0], found[1] - size)
    return window, offset


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _descending(table: pa.Table) -> pa.Table:
    lengths, numbers = (table[c].to_numpy().astype(np.int64) for c in ("length", "number"))
    return table.take(pa.array(np.lexsort((numbers, -lengths))))


PACKED = ", ".join(f"{k} {v}" for k, v in COLUMNS.items()) + ", sequence_id long, offset long"
PLACED = f"{PACKED}, number long, fill long"
NAMES = [*COLUMNS, "sequence_id", "offset"]
POOLED, WHOLE = 2 ** 61, 2 ** 62        # where the numbers of pooled and of whole windows begin


def pack_windows(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
                 shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its document's token count, its sequence and its gapless place there."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    pieces = materialize(pieces_of(docs, tokenizer, capacity).withColumn("number", F.monotonically_increasing_id()),
                         "window-pieces")
    whole = pieces.where(F.col("length") == capacity).select(
        *COLUMNS, (F.lit(WHOLE) + F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = pieces.where(F.col("length") < capacity)

    def place(table: pa.Table) -> pa.Table:
        table = _descending(table)
        lengths, numbers = (table[c].to_numpy().astype(np.int64) for c in ("length", "number"))
        window, offset = best_fit_decreasing(lengths, capacity)
        # a window is numbered by its first piece, the only one at offset 0; that number is unique
        first = np.empty(int(window.max()) + 1, np.int64)
        first[window[offset == 0]] = numbers[offset == 0]
        fill = np.zeros(len(first), np.int64)
        np.add.at(fill, window, lengths)
        return pa.table([*(table[c] for c in COLUMNS), pa.array(first[window]), pa.array(offset), pa.array(numbers),
                         pa.array(fill[window])], names=[*NAMES, "number", "fill"])

    shards = max(1, -(-rests.count() // shard_pieces))
    dealt = rests.drop("ids").withColumn("shard", F.pmod(F.xxhash64("number"), F.lit(shards)))
    placed = materialize(dealt.groupBy("shard").applyInArrow(place, PLACED), "window-placed")
    poor = F.col("fill") < F.lit(int(np.ceil(POOR_FILL * capacity)))
    return (placed.where(~poor).select(*NAMES)
            .unionByName(_pooled(rests, placed.where(poor).select("number"), capacity, shard_pieces))
            .unionByName(whole))


def _pooled(rests: DataFrame, poor: DataFrame, capacity: int, shard_pieces: int) -> DataFrame:
    """Pieces of poor windows laid end to end, cut where a window is full and at last at powers of two."""
    found = poor.count()
    pools = max(1, -(-found // shard_pieces))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, rows = _descending(table), []
        total = sum(table["length"].to_pylist())
        sizes = [capacity] * (total // capacity) + powers_of_two(total % capacity)
        at, offset, first = 0, 0, POOLED + (key[0].as_py() << 24)
        for r in table.to_pylist():
            done = 0
            while done < r["length"]:
                if offset == sizes[at]:
                    at, offset = at + 1, 0
                take = min(sizes[at] - offset, r["length"] - done)
                cut = r["ids"][4 * done:4 * (done + take)]
                rows.append((r["doc_id"], r["start"] + done, take, zlib.crc32(cut), r["doc_tokens"], first + at, offset))
                done, offset = done + take, offset + take
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=NAMES)

    # a broadcast leaves the ids of all other pieces where they are
    taken = rests.join(F.broadcast(poor) if found <= BROADCAST_POOR else poor, "number").withColumn("pool", F.pmod(F.xxhash64("number"), F.lit(pools)))
    return taken.groupBy("pool").applyInArrow(run, PACKED)
