"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and an end id; only documents longer than a sequence
are cut, into full pieces and a shorter last one. Pieces are dealt by a hash to
shards of bounded size. Each shard has several islands, each a Spark task's row
with its own population of packings. An island crosses two parents: whole
well-filled bins of one are injected into the other, bins that now hold a piece
twice are dissolved, and the displaced pieces go back by best fit, largest
first. Fitness is the mean squared fill. After each epoch the best packing of
every island migrates to the next island of the shard (one small equi-join).
A shard whose packing meets the lower bound ceil(total / capacity) stops early.
Bins that a shard leaves poorly filled are pooled with those of other shards
and packed once more, so slack is not paid per shard.

Tokens: words between blanks are independent for this tokenizer (its normaliser
and pre-tokeniser never look across white space), so ids are cached per word and
a document's ids are the concatenation; tests compare with whole-text encoding.

Defined cases: a null text is empty and gives one piece holding the end id only.
Repeated rows are packed separately. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.common import enter, on_change, texts
from kpiscope.session import materialize

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 3000     # pieces of a shard, about
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6
POOR_FILL = 0.97        # bins below are packed again together with those of other shards
CACHE_WORDS = 300_000   # of one generation; a cached word takes about 200 bytes
DOCS_AT_ONCE = 200
BYTES_AT_ONCE = 16_000_000     # of text whose words are numbered together; one document at least


# --------------------------------------------------------------------- tokens
class WordTokens:
    """Little-endian 32-bit ids of texts; the ids of words between blanks are cached.

    A word of letters is one pre-token, and so is a run of signs after it. Unknown letter words
    are encoded together, as one line: the last id of each carries the word-end mark. Other
    unknown words are encoded one by one. ASCII words are cached lower-cased too, since the
    normaliser lower-cases. The cache has two generations: when the younger is full it becomes the
    older one, from which words in use come back, so words are kept by use.
    """

    SIGNS = ".,;:!?%&$*#|()[]{}<>=+-/\"~^@"

    def __init__(self, path: str, cache_words: int | None = None):
        from tokenizers import Tokenizer
        self.most = cache_words or CACHE_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.ends))]
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode_letters(self, words: list[str]) -> None:
        """Cache words of letters. Lower-case ASCII ones go straight to the model, since neither the
        normaliser nor the byte alphabet changes them; others are encoded as lines of many words."""
        merge, raw, cache = self.tokenizer.model.tokenize, self.raw, self.cache
        cache.update([(w, b"".join([raw[t.id] for t in merge(w)])) for w in words if w.isascii() and w.islower()])
        words = [w for w in words if w not in cache]
        for at in range(0, len(words), 20_000):
            part = words[at:at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):                     # not one pre-token each: take them singly
                self._encode_others(part)
                continue
            raw, stops = ids.tobytes(), (stops * 4).tolist()
            self.cache.update(zip(part, [raw[lo:hi] for lo, hi in zip([0, *stops], stops)]))

    def _encode_others(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def _recall(self, words: set[str]) -> set[str]:
        """Bring words of the older generation back; returns those that are in neither."""
        words = words.difference(self.cache)
        again = words & self.older.keys()
        self.cache.update({w: self.older[w] for w in again})
        return words - again

    def _learn(self, missing: set[str]) -> None:
        cache = self.cache
        folded = {w: low for w in missing if w.isascii() and (low := w.lower()) != w}
        self._learn_folded(self._recall(missing.difference(folded).union(folded.values())))
        cache.update({w: cache[low] for w, low in folded.items()})

    def _learn_folded(self, missing: set[str]) -> None:
        cache = self.cache
        letters = {w for w in missing if w.isalpha()}
        signed, others = [], []
        for w in missing - letters:
            stem = w.rstrip(self.SIGNS)
            if stem and stem.isalpha():
                signed.append((w, stem, w[len(stem):]))
            else:
                others.append(w)
        letters.update([stem for _, stem, _ in signed])
        self._encode_letters(list(self._recall(letters)))
        self._encode_others(others + list(self._recall({sign for _, _, sign in signed})))
        for w, stem, sign in signed:
            cache[w] = cache[stem] + cache[sign]

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text. Words are numbered first, so Python meets each distinct word once."""
        if len(self.cache) > self.most:
            self.cache, self.older = {"": b""}, self.cache
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        words, at = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        missing = self._recall(set(words))
        if missing:
            self._learn(missing)
        raw = list(map(self.cache.__getitem__, words))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        ids, starts = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = []
        for lo in range(0, len(split), DOCS_AT_ONCE):       # the ids of few documents are laid out at a time
            some = at[cuts[lo]:cuts[min(lo + DOCS_AT_ONCE, len(split))]]
            n = sizes[some]
            ends = np.concatenate([[0], np.cumsum(n)])
            whole = ids[np.repeat(starts[some] - ends[:-1], n) + np.arange(ends[-1])]
            marks = ends[cuts[lo:lo + DOCS_AT_ONCE + 1] - cuts[lo]].tolist()
            found += [whole[i:j].tobytes() for i, j in zip(marks, marks[1:])]
        return found


@lru_cache(maxsize=2)
def word_tokens(path: str, cache_words: int) -> WordTokens:
    return WordTokens(path, cache_words)


on_change(word_tokens.cache_clear)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def parts_of(text: pa.Array, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together."""
    block = np.cumsum(pc.binary_length(text).to_numpy()) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(text)]
    yield from ((lo, hi) for lo, hi in zip(cuts, cuts[1:]) if lo < hi)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, part_bytes: int = BYTES_AT_ONCE,
              cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row for each piece of each whole text. The two sizes trade a worker's memory for time, not results."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        encode = word_tokens(tokenizer, cache_words)
        for b in batches:
            for lo, hi in parts_of(b["text"], part_bytes):
                part = b.slice(lo, hi - lo)
                rows = []
                for doc_id, ids in zip(part["doc_id"].to_pylist(), encode(part["text"])):
                    ids += end
                    for k, cut in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[cut:cut + 4 * capacity]
                        rows.append((doc_id, k, cut // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), ARROW)], names=NAMES)
                del rows
                pa.default_memory_pool().release_unused()

    return texts(docs).mapInArrow(run, PIECES)


# ---------------------------------------------------------- genetic algorithm
def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray, room: dict[int, int]) -> None:
    """Put pieces in order into the bin with the least room that holds them; opens bins as needed."""
    free = sorted((r, b) for b, r in room.items())
    fresh = max(room, default=-1) + 1
    for i in order.tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = capacity, fresh
            fresh += 1
        bins[i] = b
        bisect.insort(free, (r - size, b))


def fills(sizes: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=sizes)


def renumbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins; fewer and fuller bins score higher."""
    f = fills(sizes, bins)
    return float(((f[f > 0] / capacity) ** 2).mean()) if len(bins) else 1.0


def first_packing(sizes: np.ndarray, capacity: int, rng: np.random.Generator | None) -> np.ndarray:
    """Best fit, largest first; with ``rng`` the order is blurred."""
    key = sizes if rng is None else sizes * rng.uniform(0.85, 1.0, len(sizes))
    bins = np.empty(len(sizes), np.int32)
    best_fit(sizes, np.argsort(-key, kind="stable"), capacity, bins, {})
    return bins


def cross(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Child: bins of the taker, with whole well-filled bins of the giver injected."""
    f = fills(sizes, giver)
    full = np.argsort(-f)[:max(1, len(f) // 2)]
    inject = full[rng.random(len(full)) < 0.5] if len(full) > 1 else full
    moved = np.isin(giver, inject)
    broken = np.unique(taker[moved])                       # these would hold a piece twice
    displaced = np.flatnonzero(np.isin(taker, broken) & ~moved)
    child = taker.copy()
    base = int(taker.max()) + 1
    child[moved] = giver[moved] + base
    stay = np.ones(len(sizes), bool)
    stay[displaced] = False
    room = {int(b): capacity - int(u) for b, u in enumerate(fills(sizes[stay], child[stay])) if u > 0}
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], capacity, child, room)
    return renumbered(child)


def mutate(sizes: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve the emptiest bin and a few others, and best-fit their pieces again."""
    f = fills(sizes, bins)
    gone = np.unique(np.append(rng.choice(len(f), min(4, len(f)), replace=False), np.argmin(f)))
    loose = np.flatnonzero(np.isin(bins, gone))
    child = bins.copy()
    room = {int(b): capacity - int(u) for b, u in enumerate(f) if b not in set(gone.tolist())}
    best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], capacity, child, room)
    return renumbered(child)


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int,
           rng: np.random.Generator) -> list[np.ndarray]:
    """Steady-state evolution; best packing first. Stops at the lower bound of bins."""
    bound = -(-int(sizes.sum()) // capacity)
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: -x[0])
    made = len(scored)
    for _ in range(generations):
        if int(scored[0][2].max(initial=-1)) + 1 <= bound:
            break
        for _ in range(len(scored)):
            i, j = sorted(rng.choice(len(scored), 2, replace=False)) if len(scored) > 1 else (0, 0)
            child = cross(sizes, scored[i][2], scored[j][2], capacity, rng)
            if rng.random() < 0.5:
                child = mutate(sizes, child, capacity, rng)
            scored.append((fitness(sizes, child, capacity), made, child))
            made += 1
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:len(population)]
    return [p for _, _, p in scored]


# -------------------------------------------------------------------- islands
STATE = "shard long, island int, sizes binary, population binary, best binary, score double, settled boolean"


def _epoch(capacity: int, epoch: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                sizes = np.frombuffer(r.sizes, np.int32)
                rng = np.random.default_rng([int(r.shard) & 0x7FFFFFFF, int(r.island), epoch])
                if r.population is None:
                    first = first_packing(sizes, capacity, None if r.island == 0 else rng)
                    people = [first]
                    if int(first.max(initial=-1)) + 1 > -(-int(sizes.sum()) // capacity):
                        people += [first_packing(sizes, capacity, rng) for _ in range(POPULATION - 1)]
                else:
                    people = list(np.frombuffer(r.population, np.int32).reshape(-1, len(sizes)))
                    if r.migrant is not None:
                        people[-1:] = [np.frombuffer(r.migrant, np.int32)]
                people = evolve(sizes, people, capacity, GENERATIONS, rng) if not r.settled else people
                settled = int(people[0].max(initial=-1)) + 1 <= -(-int(sizes.sum()) // capacity)
                rows.append((r.shard, r.island, r.sizes, np.stack(people).tobytes(), people[0].tobytes(),
                             fitness(sizes, people[0], capacity), settled))
            yield pd.DataFrame(rows, columns=["shard", "island", "sizes", "population", "best", "score", "settled"])
    return run


def best_packings(sizes: DataFrame, capacity: int, shards: int) -> DataFrame:
    """``shard, best`` (bin of each piece, largest piece first) from ``shard, sizes`` rows."""
    state = (sizes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
             .withColumns({"population": F.lit(None).cast("binary"), "migrant": F.lit(None).cast("binary"),
                           "settled": F.lit(False)}))
    width = max(1, min(-(-shards * ISLANDS // 8), 100_000))
    ended = []
    for epoch in range(EPOCHS):
        state = materialize(state.repartition(width, "shard", "island").mapInPandas(_epoch(capacity, epoch), STATE),
                            "packing-islands")
        ended.append(state if epoch == EPOCHS - 1 else state.where("settled"))
        open_ = state.where(~F.col("settled"))
        if epoch == EPOCHS - 1 or open_.isEmpty():
            break
        elite = open_.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("migrant"))
        state = open_.drop("best", "score").join(elite, ["shard", "island"], "left")
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    return every.groupBy("shard").agg(F.max_by("best", F.struct("score", (-F.col("island")).alias("i"))).alias("best"))


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    """Pieces of a shard in the order that packings refer to: largest first, ties by number."""
    return frame.sort_values(["length", "number"], ascending=[False, True], ignore_index=True)


PACKED = f"{PIECES}, number long, sequence_id long, offset long, fill long"


def _pack_round(pieces: DataFrame, capacity: int, first_id: int, shard_pieces: int) -> DataFrame:
    """Pieces with sequence and offset; one genetic search for each shard of pieces."""
    n = pieces.count()
    shards = max(1, -(-n // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("number", F.lit(first_id)), F.lit(shards))
                              if n else F.lit(0).cast("long"))

    def gather(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "sizes": [_ordered(frame)["length"].to_numpy(np.int32).tobytes()]})

    def place(key: tuple, frame: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        bins = np.frombuffer(chosen["best"].iloc[0], np.int32)
        length = frame["length"].to_numpy(np.int64)
        by = np.argsort(bins, kind="stable")
        before = np.cumsum(length[by]) - length[by]
        starts = np.concatenate([[True], np.diff(bins[by]) != 0])
        offset = np.empty(len(by), np.int64)
        offset[by] = before - np.maximum.accumulate(np.where(starts, before, 0))
        frame["sequence_id"] = first_id + int(key[0]) * 2 ** 24 + bins.astype(np.int64)
        frame["offset"] = offset
        frame["fill"] = fills(length, bins).astype(np.int64)[bins]
        return frame[[c.split()[0] for c in PACKED.split(", ")]]

    sizes = dealt.groupBy("shard").applyInPandas(gather, "shard long, sizes binary")
    best = best_packings(sizes, capacity, shards)
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, PACKED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES,
         part_bytes: int = BYTES_AT_ONCE, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Every piece with its sequence and its gapless place there; ``pieces_of`` explains the last two sizes."""
    # rows are dealt by a number of their own, so rows that repeat a document spread over the shards
    pieces = materialize(pieces_of(docs, tokenizer, capacity, part_bytes, cache_words).withColumn("number", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") >= capacity).select(
        *NAMES, (F.col("number") + F.lit(2 ** 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = materialize(_pack_round(pieces.where(F.col("length") < capacity), capacity, 0, shard_pieces), "packed")
    poor = F.col("fill") < int(POOR_FILL * capacity)
    again = _pack_round(packed.where(poor).select(*pieces.columns), capacity, 2 ** 61, shard_pieces)
    names = whole.columns
    return (packed.where(~poor).select(*names).unionByName(again.select(*names)).unionByName(whole))
