"""SimHash near-duplicates, linked through vantage-point trees.

Fingerprint: words are runs of non-blank bytes after lower-casing A-Z, shingles
are runs of ``shingle`` words joined by blanks (all words when there are fewer),
each hashed by XXH64 with seed 42; a bit of the fingerprint is 1 if it is set in
more than half of the hashes. A text without words has fingerprint zero, which
links like any other.

Search: copies collapse first, since one row per distinct fingerprint is enough.
A top tree, built from a bounded hash sample of fingerprints, assigns every
fingerprint to one leaf by its Hamming distances to vantage points. Leaves are
cut into chunks of bounded size. A chunk sends each other chunk only those of
its fingerprints whose ball of the given radius reaches that chunk's leaf by the
triangle bounds. Every pair of chunks is then joined by a local vantage-point
tree, which prunes branches with the same bounds and compares what is left
exactly. Inside a pair, links are reduced to stars of their connected groups as
they are found, so a dense cluster never yields all its pairs.

Components: large-star / small-star rounds over the links, each round written
to the shared checkpoint folder.

Defined cases: a null text is an empty text. Rows that repeat a doc_id repeat
their result. A null doc_id takes part but never names a component; only a
component of null ids alone has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiscope.llm.common import enter, texts
from kpiscope.session import materialize

SEED = 42               # fixed by the contract
TREE_SAMPLE = 4096      # fingerprints that the top tree is built from, about
CHUNK = 16_384          # fingerprints in one chunk, at most about
BRUTE = 48              # a local node with so few members or queries is compared exactly
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    import xxhash
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends - [len(w) + 1 for w in words])[:len(words) - shingle + 1].tolist()
        hashes = [h(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=np.uint64)
    for at in range(0, len(values), 65_536):        # long texts in parts: bounded memory
        part = values[at:at + 65_536].view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for b in batches:
            for at in range(0, len(b), 1000):               # texts of few documents are held at a time
                part = b.slice(at, 1000)
                fps = np.array([fingerprint(t, shingle) for t in part["text"].to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    return texts(docs).mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------ top tree
def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def build_tree(sample: np.ndarray, leaf: int, rng: np.random.Generator):
    """('leaf', id) or (vantage point, radius, near tree, far tree); ids count from 0 by ``number``."""
    if len(sample) <= leaf:
        return None
    best = None
    for point in rng.choice(sample, min(8, len(sample)), replace=False):
        d = distance(sample, point)
        radius = int(np.median(d))
        near = d <= radius
        if near.all():
            radius = int(d.min())
            near = d <= radius
        if near.all():
            continue
        score = abs(int(near.sum()) * 2 - len(sample)) / len(sample) - d.std() / 8
        if best is None or score < best[0]:
            best = (score, np.uint64(point), radius, near)
    if best is None:
        return None
    _, point, radius, near = best
    return point, radius, build_tree(sample[near], leaf, rng), build_tree(sample[~near], leaf, rng)


def leaf_of(tree, fps: np.ndarray) -> np.ndarray:
    """Home leaf of each fingerprint."""
    home = np.zeros(len(fps), np.int64)
    def walk(node, rows, first):
        if node is None:
            home[rows] = first
            return first + 1
        near = distance(fps[rows], node[0]) <= node[1]
        return walk(node[3], rows[~near], walk(node[2], rows[near], first))
    walk(tree, np.arange(len(fps)), 0)
    return home


def leaves_in_reach(tree, fps: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """(leaf, rows whose ball of ``radius`` overlaps it by the triangle bounds) for each leaf."""
    out = []
    def walk(node, rows, first):
        if node is None:
            out.append((first, rows))
            return first + 1
        d = distance(fps[rows], node[0])
        first = walk(node[2], rows[d - radius <= node[1]], first)
        return walk(node[3], rows[d + radius > node[1]], first)
    walk(tree, np.arange(len(fps)), 0)
    return out


# ---------------------------------------------------------------- local join
class Groups:
    """Connected groups of local rows; label = smallest row known to be connected."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            open_ = la != lb
            if not open_.any():
                return
            a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                nxt = self.label[self.label]
                if (nxt == self.label).all():
                    break
                self.label = nxt


def join_pair(members: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fingerprint, smallest-row fingerprint of its group) of members and queries within radius.

    Rows: members first, then queries; a self-join passes the same array twice.
    """
    same = queries is members
    fps = members if same else np.concatenate([members, queries])
    shift = 0 if same else len(members)
    groups = Groups(len(fps))
    rng = np.random.default_rng(7)

    def compare(m, q):
        for at in range(0, len(q), max(1, 1_000_000 // max(1, len(m)))):
            part = q[at:at + max(1, 1_000_000 // max(1, len(m)))]
            hit = np.bitwise_count(members[m][None, :] ^ queries[part][:, None]) <= radius
            i, j = np.nonzero(hit)
            groups.link(part[i] + shift, m[j])

    stack = [(np.arange(len(members)), np.arange(len(queries)))]
    while stack:
        m, q = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) <= BRUTE or len(q) <= BRUTE // 4:
            compare(m, q)
            continue
        point = members[m[rng.integers(len(m))]]
        d = np.bitwise_count(members[m] ^ point).astype(np.int16)
        cut = int(np.median(d))
        near = d <= cut
        if near.all():
            cut = int(d.min())
            near = d <= cut
        if near.all():                      # equal distances: no split by this point
            tight = cut * 2 <= radius       # all members lie within the radius of each other
            if tight:
                groups.link(m, np.full(len(m), m[0]))
            compare(m[:1], q) if tight and cut == 0 else compare(m, q)
            continue
        dq = np.bitwise_count(queries[q] ^ point).astype(np.int16)
        stack.append((m[near], q[dq - radius <= cut]))
        stack.append((m[~near], q[dq + radius > cut]))
    root = groups.label
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def near_links(fps: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that connect what Hamming distances up to ``radius`` connect, over distinct ``fp`` rows."""
    spark = fps.sparkSession
    total = fps.count()
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    share = min(1.0, TREE_SAMPLE / total)
    sample = np.array([r["fp"] for r in fps.where(
        F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(1_000_000)) < int(share * 1e6)).collect()], dtype=np.int64)
    sample = np.sort(sample).view(np.uint64)
    tree = build_tree(sample, max(2, int(len(sample) * chunk / total)), np.random.default_rng(11)) \
        if total > chunk and len(sample) >= 16 else None

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("simhash")
        for b in batches:
            yield pd.DataFrame({"fp": b["fp"], "leaf": leaf_of(tree, b["fp"].to_numpy(np.int64).view(np.uint64))})

    placed = materialize(fps.select("fp").mapInPandas(homes, "fp long, leaf long"), "simhash-leaves")
    loads = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    parts = {leaf: -(-n // chunk) for leaf, n in loads.items()}     # chunks of a leaf: a dense one has many
    pieces = F.create_map(*[F.lit(v) for leaf, n in sorted(parts.items()) for v in (leaf, n)])
    chunks = placed.withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), pieces[F.col("leaf")]))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """One row for the chunk itself, and one for each later chunk with the rows that reach it."""
        leaf, part = int(key[0]), int(key[1])
        own = np.sort(frame["fp"].to_numpy(np.int64).view(np.uint64))
        rows = []
        for other, reach in leaves_in_reach(tree, own, radius):
            if len(reach):
                for p in range(parts.get(other, 0)):
                    if (other, p) >= (leaf, part):
                        rows.append((other, p, leaf, part, own[reach].tobytes()))
        return pd.DataFrame(rows, columns=["leaf", "part", "from_leaf", "from_part", "fps"])

    sent = materialize(chunks.groupBy("leaf", "part").applyInPandas(
        pack, "leaf long, part long, from_leaf long, from_part long, fps binary"), "simhash-chunks")
    own = sent.where("leaf = from_leaf and part = from_part").select("leaf", "part", F.col("fps").alias("members"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("simhash")
        for b in batches:
            for members, queries, itself in zip(b["members"], b["fps"], b["itself"]):
                m = np.frombuffer(members, np.uint64)
                a, to = join_pair(m, m if itself else np.frombuffer(queries, np.uint64), radius)
                yield pd.DataFrame({"a": a.view(np.int64), "b": to.view(np.int64)})

    pairs = sent.join(own, ["leaf", "part"]).select(
        "members", "fps", ((F.col("leaf") == F.col("from_leaf")) & (F.col("part") == F.col("from_part"))).alias("itself"))
    tasks = sum(parts.values())
    # a few chunk pairs (CHUNK * 8 bytes a side) for each task
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(tasks * (tasks + 1) // 8, 100_000))
    return pairs.repartition(width).mapInPandas(compare, "a long, b long").distinct()


# ---------------------------------------------------------------- components
def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` (smallest node reachable) of every node that has a link: large-star / small-star."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "links")

    def mark(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0)),
                               F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    seen = mark(edges)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "links")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = materialize(with_fingerprints(docs, shingle), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), max_bits))
    class_of = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
                .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = class_of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = class_of.join(named, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """The documents, all columns, without those whose component has a smaller doc_id.

    Repeated rows of one doc_id shrink to one row. Rows without a doc_id cannot be
    named by a component and stay.
    """
    found = near_duplicates(docs, shingle, max_bits)
    drop = found.where("component_id < doc_id").select(F.col("doc_id").alias("_drop")).distinct()
    kept = docs.join(drop, docs["doc_id"].cast("long") == drop["_drop"], "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    names = kept.columns
    known, nameless = kept.where("doc_id is not null"), kept.where("doc_id is null")
    return known.dropDuplicates(["doc_id"]).select(*names).unionByName(nameless)
