"""Approximate nearest neighbours by multi-index hashing.

Codes: on a bounded hash sample of vectors several rotations are learned by
iterative quantisation (ITQ); the signs of the rotated, centred vectors are the
bits. Every vector gets a code and every code is indexed. The index is written
once to the checkpoint folder: a row is a shard of bounded bytes with its ids,
vectors, codes and one bucket table for each substring of the codes.

Search: the queries are the stated set (ids divisible by a number), each
distinct (id, vector) once. They meet the index in blocks of bounded size, so
neither side is ever whole in one place and no pairs are shuffled. By the
pigeonhole principle, a code within radius r of a query differs in at most
r // m bits (for the first r % m + 1 substrings) or one less (for the others) in
at least one of m substrings, so probing these balls of bucket keys retrieves
every code within the radius. Retrieved codes are verified by their full Hamming
distance and reranked by exact Euclidean distance on the original vectors in
double precision. Each task keeps only the best k of each query, and one small
aggregation merges the tasks.

The radius belongs to each query. On the sample, a table is fitted that tells for
a Euclidean distance the Hamming distance that the stated share of pairs so far
apart stay within. A query's k-th best distance so far (at first that to the
sample, itself part of the table) gives the radius it still needs. The radius
grows from the first ball of keys on until that need is covered, while the need
shrinks with what is found and is carried on to the task's next shards. Beyond the
distances of the table, and with fewer than k found, all codes are in the ball.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; vectors of different lengths are no neighbours, and the
vectors of each length are searched by themselves, with codes and table of their
own; rows with equal ids are separate candidates, but none that has the query's
own id; ties go to the smaller id; a repeated query row repeats its result; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kpiscope.session import materialize

SAMPLE_VECTORS = 8192       # vectors that rotations and reach are fitted on, about
CODE_BITS = 128
SUBSTRING_BITS = 16
RECALL = 0.985              # share of pairs at a distance that its radius must hold
QUERY_BLOCK = 4096          # queries that meet the index at a time, about
SHARD_BYTES = 4_000_000     # bytes of vectors in a shard, about
FIRST_BALLS = 3             # growing steps of a query before its whole need is probed


@dataclass
class Codes:
    """Centre and rotations; the signs of (x - centre) @ rotation are the bits."""

    centre: np.ndarray
    rotation: np.ndarray        # dimensions x bits

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Rows of substrings (16 bits each)."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1).view(np.uint16)


def learn_codes(x: np.ndarray, bits: int = CODE_BITS, rounds: int = 25) -> Codes:
    """ITQ: principal axes, then rotations that bring the data close to the corners of a cube.
    Several independent rotations are laid side by side until the bits are filled."""
    d = x.shape[1]
    centre = x.mean(axis=0)
    y = x - centre
    _, axes = np.linalg.eigh(y.T @ y / len(y) + 1e-12 * np.eye(d))
    axes = axes[:, ::-1][:, :min(d, bits)]
    v = y @ axes
    rng = np.random.default_rng(3)
    out = []
    while sum(r.shape[1] for r in out) < bits:
        r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ vt).T
        out.append(axes @ r)
    return Codes(centre, np.concatenate(out, axis=1)[:, :bits])


def hamming(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(axis=1, dtype=np.int32)


@dataclass
class Reach:
    """Hamming radius by Euclidean distance: ``bits[i]`` up to ``distance[i]``, all bits beyond the last."""

    distance: np.ndarray
    bits: np.ndarray

    def radius(self, distance: float) -> int:
        at = int(np.searchsorted(self.distance, distance))
        return int(self.bits[at]) if at < len(self.bits) else CODE_BITS


def learn_reach(x: np.ndarray, codes: Codes, k: int, recall: float = RECALL, queries: int = 400, steps: int = 32) -> Reach:
    """Fitted on pairs of sample vectors and their k nearest. Neighbours in the whole table are closer than in a
    sample, so each pair also counts at halved distances, its farther vector moved along the line."""
    c, far, bits = codes.encode(x), [], []
    for i in range(0, len(x), max(1, len(x) // queries)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[:k] if len(x) > k else np.flatnonzero(np.isfinite(d))
        for share in (1.0, 0.5, 0.25, 0.125, 0.0625):
            far.append(share * np.sqrt(d[near]))
            bits.append(hamming(codes.encode(x[i] + share * (x[near] - x[i])), c[i]))
    if not far or not sum(map(len, far)):
        return Reach(np.zeros(0), np.zeros(0, np.int64))
    far, bits = np.concatenate(far), np.concatenate(bits)
    by = np.argsort(far, kind="stable")
    parts = [p for p in np.array_split(by, steps) if len(p)]
    need = [int(np.quantile(bits[p], recall, method="higher")) for p in parts]
    return Reach(np.array([far[p[-1]] for p in parts]), np.maximum.accumulate(need))


_ONES = np.bitwise_count(np.arange(1 << SUBSTRING_BITS, dtype=np.uint16))
_BALLS = [np.flatnonzero(_ONES <= r).astype(np.uint16) for r in range(SUBSTRING_BITS + 1)]


class MultiIndex:
    """One bucket table for each substring of the codes of a shard: its keys, where each key's rows start, the rows."""

    def __init__(self, codes: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None):
        self.codes = codes
        self.tables = tables or [self._table(codes[:, s]) for s in range(codes.shape[1])]

    @staticmethod
    def _table(column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(column, kind="stable").astype(np.int32)
        keys, starts = np.unique(column[order], return_index=True)
        return keys, np.append(starts, len(column)).astype(np.int32), order

    def _bucket_rows(self, s: int, key: np.uint16, bits: int) -> np.ndarray:
        """Rows whose substring ``s`` differs from the key in at most ``bits`` bits."""
        keys, starts, order = self.tables[s]
        ball = _BALLS[min(bits, SUBSTRING_BITS)]
        if len(ball) < len(keys):
            probe = ball ^ key
            at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            at = at[keys[at] == probe]
        else:
            at = np.flatnonzero(np.bitwise_count(keys ^ key) <= bits)
        n = starts[at + 1] - starts[at]
        return order[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def probed(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Which rows the probes for a radius retrieve: all within it, and others."""
        n, m = self.codes.shape
        if radius >= m * SUBSTRING_BITS:
            return np.ones(n, bool)
        each, rest = divmod(radius, m)
        if len(_BALLS[min(each, SUBSTRING_BITS)]) * 4 > n:      # more keys than rows: the rows' substrings are compared at once
            allowed = np.where(np.arange(m) <= rest, each, each - 1)
            return (np.bitwise_count(self.codes ^ query) <= allowed).any(axis=1)
        seen = np.zeros(n, bool)
        for s in range(m):
            bits = each if s <= rest else each - 1
            if bits >= 0:
                seen[self._bucket_rows(s, query[s], bits)] = True
        return seen

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code lies within the radius of the query's code."""
        rows = np.flatnonzero(self.probed(query, radius))
        return rows[hamming(self.codes[rows], query) <= radius]


@dataclass
class Best:
    """The best k of a query so far, and a distance that its k-th best surely does not exceed."""

    ids: np.ndarray
    distance: np.ndarray
    limit: float

    def add(self, ids: np.ndarray, distance: np.ndarray, k: int) -> None:
        ids, distance = np.concatenate([self.ids, ids]), np.concatenate([self.distance, distance])
        by = np.lexsort((ids, distance))[:k]
        self.ids, self.distance = ids[by], distance[by]
        if len(by) == k:
            self.limit = min(self.limit, float(self.distance[-1]))


def search_shard(index: MultiIndex, ids: np.ndarray, x: np.ndarray, own: int, query: np.ndarray, code: np.ndarray,
                 best: Best, reach: Reach, k: int) -> tuple[int, int]:
    """Bring ``best`` up to date with a shard; the numbers of rows probed and reranked."""
    m, step, probed, reranked = index.codes.shape[1], 0, None, 0
    need, covered = reach.radius(best.limit), -1
    while covered < need:
        step += 1
        radius = min(need, m * step - 1) if step <= FIRST_BALLS else need
        now = index.probed(code, radius)
        fresh = np.flatnonzero(now if probed is None else now & ~probed)
        probed, covered = now if probed is None else now | probed, radius
        # rows beyond the need of this moment are never needed later: it only shrinks
        fresh = fresh[(hamming(index.codes[fresh], code) <= need) & (ids[fresh] != own)]
        if len(fresh):
            reranked += len(fresh)
            best.add(ids[fresh], np.sqrt(((x[fresh].astype(np.float64) - query) ** 2).sum(axis=1)), k)
            need = reach.radius(best.limit)
    return int(probed.sum()) if probed is not None else 0, reranked


FOUND = "query_id long, query_row long, vec_id long, score double"
SHARD = "n int, wide boolean, ids binary, vectors binary, codes binary, keys array<binary>, starts array<binary>, rows array<binary>"


def valid_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part."""
    v = F.col(vector).cast(T.ArrayType(T.DoubleType()))
    fine = (F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)


def build_index(rows: DataFrame, codes: Codes, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows, written once: a row for each shard."""
    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shard(frames: list[pd.DataFrame]) -> pd.DataFrame:
            x = np.stack([v for f in frames for v in f["v"]]).astype(np.float64)
            index = MultiIndex(shared.value.encode(x))
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            wide = not np.array_equal(short, x)             # vectors of floats are kept as floats, exactly
            keys, starts, order = ([a.tobytes() for a in part] for part in zip(*index.tables))
            return pd.DataFrame([{
                "n": len(x), "wide": wide, "ids": np.concatenate([f["vec_id"].to_numpy(np.int64) for f in frames]).tobytes(),
                "vectors": (x if wide else short).tobytes(), "codes": index.codes.tobytes(),
                "keys": keys, "starts": starts, "rows": order}])

        frames, size = [], 0
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo:lo + 1024]
                frames.append(part)
                size += 4 * len(part) * len(part["v"].iloc[0])
                if size >= shard_bytes:
                    yield shard(frames)
                    frames, size = [], 0
        if frames:
            yield shard(frames)

    return materialize(rows.mapInPandas(run, SHARD), "neighbour-index")


def _search(index: DataFrame, shared, k: int) -> DataFrame:
    """The best k of each query in each task, for one block of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, reach, own, query_rows, queries, limits = shared.value
        codes = model.encode(queries)
        best = [Best(np.zeros(0, np.int64), np.zeros(0), limit) for limit in limits]
        for b in batches:
            for r in b.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                x = np.frombuffer(r.vectors, np.float64 if r.wide else np.float32).reshape(r.n, -1)
                tables = [(np.frombuffer(a, np.uint16), np.frombuffer(s, np.int32), np.frombuffer(o, np.int32))
                          for a, s, o in zip(r.keys, r.starts, r.rows)]
                shard = MultiIndex(np.frombuffer(r.codes, np.uint16).reshape(r.n, -1), tables)
                for i, held in enumerate(best):
                    search_shard(shard, ids, x, own[i], queries[i], codes[i], held, reach, k)
        sizes = [len(held.ids) for held in best]
        yield pd.DataFrame({"query_id": np.repeat(own, sizes), "query_row": np.repeat(query_rows, sizes),
                            "vec_id": np.concatenate([held.ids for held in best]),
                            "score": np.concatenate([held.distance for held in best])})

    return index.mapInPandas(run, FOUND)


def first_limits(sample_ids: np.ndarray, sample: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Distance of each query to its k-th nearest sample vector of another id (infinite if there are fewer)."""
    limits = np.full(len(queries), np.inf)
    norms = (sample ** 2).sum(axis=1)
    for lo in range(0, len(queries), 256):
        q = queries[lo:lo + 256]
        d = norms + (q ** 2).sum(axis=1)[:, None] - 2 * (q @ sample.T)
        d[own[lo:lo + 256, None] == sample_ids] = np.inf
        if len(sample) >= k:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            # the product rounds: a little more is still a bound
            limits[lo:lo + 256] = np.sqrt(np.maximum(kth, 0) + 1e-9 * (norms.max() + (q ** 2).sum(axis=1)))
    return limits


def nearest(rows: DataFrame, every: int, k: int, sample_vectors: int = SAMPLE_VECTORS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id is divisible by ``every``."""
    spark = rows.sparkSession
    own = valid_vectors(rows)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("asked"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sizes.where("asked > 0").orderBy("d").collect():
        out = out.unionByName(_nearest(own.where(F.size("v") == r["d"]), r["n"], is_query, k, sample_vectors))
    return out


def _nearest(own: DataFrame, total: int, is_query: Column, k: int, sample_vectors: int) -> DataFrame:
    """The search among ``total`` vectors of one length."""
    context = own.sparkSession.sparkContext
    # equal rows are taken once, so that a repeated row fills neither the sample nor a block
    share = F.pmod(F.xxhash64("vec_id", "v", F.lit("sample")), F.lit(1_000_000)) < int(min(1.0, sample_vectors / total) * 1e6)
    sample = sorted(own.where(share).distinct().collect(), key=lambda r: (r["vec_id"], r["v"]))
    if len(sample) < 2:
        sample = own.limit(2).collect()
    sample_ids, x = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["v"] for r in sample])
    codes = learn_codes(x)
    reach = learn_reach(x, codes, k)
    index = build_index(own, codes)
    queries = materialize(own.where(is_query).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
                          .withColumn("query_row", F.monotonically_increasing_id()), "neighbour-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_row", F.lit("block")), F.lit(blocks))
    parts = []
    for b in range(blocks):
        asked = queries.where(block == b).select("vec_id", "v", "query_row").collect()
        if not asked:
            continue
        ids, vectors = np.array([r["vec_id"] for r in asked], np.int64), np.array([r["v"] for r in asked])
        limits = first_limits(sample_ids, x, ids, vectors, k)
        if len(sample) < k:
            limits[:] = np.inf
        shared = context.broadcast((codes, reach, ids, np.array([r["query_row"] for r in asked], np.int64), vectors, limits))
        parts.append(materialize(_merged(_search(index, shared, k), k), "neighbours"))
        shared.destroy()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    copies = queries.where("copies > 1").select("query_row", "copies")
    repeated = out.join(copies, "query_row").select(out.columns + [F.explode(F.sequence(F.lit(2), F.col("copies").cast("int")))])
    return out.select("query_id", "rank", "vec_id", "score").unionByName(repeated.select("query_id", "rank", "vec_id", "score"))


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k over all tasks; at most k rows of each task meet for one query."""
    by = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
