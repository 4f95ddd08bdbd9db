"""Okapi BM25 ranking as a distributed job.

Plan::

    corpus text --split on headings (per row, no shuffle)--> chunks         T1
    chunks --tokenize, count in the row (no shuffle)--> (term, tf) array   T2
    exploded tf --> HashAggregate (term) = df --> idf; scalars N, avgdl,   T3
          mean idf: one small aggregate
    queries --tokenize--> (query, term, qtf) JOIN idf ON term
    postings (materialized) JOIN query terms ON term: only postings of     T4
          query terms get an impact (an integer of 1e-9); the query side is
          broadcast when its bytes are measured small, so a term present in
          every chunk is no hot shuffle key
    --> these postings dealt out by chunk, JOIN (query, term, qtf)
    --> HashAggregate (query, chunk) = exact integer sum of qtf x impact;
          a chunk's postings are in one task: pairs are never shuffled
    top k: the k-th best score among a share of the chunks is a floor of    T5
          the k-th best of all; only pairs that reach it are sorted
    top k without scoring every pair (``pruned``; from PRUNE_FROM_PAIRS
          pairs on, which the document frequencies tell beforehand):
      postings of query terms --> impact, block of chunks; maximal impact
          of each term and of each (term, block)
      the terms with the largest bounds alone give k scores each: the
          smallest of them is a floor of the k-th best score
      terms whose bounds together stay under the floor are not essential:
          no chunk that holds only these can be among the best
      partial scores over essential terms raise the floor; what partial
          score + block bound of the other terms cannot reach it goes
      the other terms' impacts are looked up for the survivors only
    --> row_number per query with a group limit, score > 0, 4 decimals

The scoring constants (k1 = 1.5, b = 0.75, negative idf floored at
0.25 x mean idf) are the published Okapi defaults of the common Python package.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiscope.functions.fixed import BM25_B, BM25_EPSILON, BM25_K1, RETRIEVAL_TOP_K
from kpiscope.functions.numeric import round_to

# Largest query-term table that is broadcast to the postings, in bytes of its terms and numbers.
BROADCAST_QUERY_BYTES = 32 * 1024 * 1024

HEADING_SPLIT_RE = r"(?md)(?=^#{1,3}[ \t\x0B\f\r]+[^\n])"
HEADING_RE = r"^#{1,3}[ \t\x0B\f\r]+([^\n]+)"
TOKEN_RE = r"[a-z0-9_]{2,}"   # whole runs of these characters: a run of one is no token


def tokens(text: Column) -> Column:
    """Lower-case, keep [a-z0-9_] runs (everything else separates), drop
    one-character tokens. Order and repeats are kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)


def section_chunks(docs: DataFrame, id_col: str = "source", text_col: str = "value") -> DataFrame:
    """Markdown sections. A line '#', '##' or '###' + blank + text opens a
    section (its heading line belongs to it); text before the first heading is
    'overview'; content is stripped; empty sections are dropped."""
    text = F.col(text_col)
    # a text without '#' cannot hold a heading: skip the regex split for it
    pieces = F.when(F.instr(text, "#") > 0, F.split(text, HEADING_SPLIT_RE)).otherwise(F.array(text))
    parts = docs.select(F.col(id_col).alias("source"),
                        F.posexplode(pieces).alias("section_no", "part"))
    is_head = F.col("part").startswith("#") & F.col("part").rlike(HEADING_RE)
    head = F.regexp_extract(F.col("part"), HEADING_RE, 1)
    ws = F.lit(" \t\n\x0b\f\r")
    content = F.btrim(F.col("part"), ws)
    name = F.when(is_head, F.btrim(head, ws)).otherwise(F.lit("overview"))
    return (parts.select("source", F.col("section_no").cast("bigint").alias("section_no"),
                         name.alias("section"), content.alias("content"))
                 .where(F.col("content") != ""))


def postings(chunks: DataFrame, key_cols=("source", "section_no")) -> DataFrame:
    """A row for each chunk: keys, section, length dl, and ``terms``, its distinct terms with their counts tf.

    The tokens of a chunk lie in one row, so they are counted there, without a shuffle: in sorted order a
    term begins where a token differs from the one before it, and its count is the way to the next
    beginning. A chunk without tokens keeps its row, since it counts in N and avgdl.
    """
    keys = list(key_cols)
    tok = chunks.select(*keys, "section", F.sort_array(tokens(F.col("content"))).alias("toks"))
    at = F.when(F.size("toks") > 0, F.sequence(F.lit(0), F.size("toks") - 1)).otherwise(F.array().cast("array<int>"))
    tok = tok.select("*", F.filter(at, lambda i: ~F.get("toks", i).eqNullSafe(F.get("toks", i - 1))).alias("starts"))
    terms = F.transform("starts", lambda i, j: F.struct(
        F.get("toks", i).alias("term"),
        (F.coalesce(F.get("starts", j + 1), F.size("toks")) - i).cast("bigint").alias("tf")))
    return tok.select(*keys, "section", F.size("toks").cast("bigint").alias("dl"), terms.alias("terms"))


def idf_table(tf: DataFrame, n_docs: int) -> DataFrame:
    """Document frequency and raw idf = ln(N - df + 0.5) - ln(df + 0.5)."""
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(n_docs)) - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    return df_.withColumn("raw_idf", idf)


def final_idf(idf: DataFrame, eps: float) -> DataFrame:
    return idf.withColumn("idf", F.when(F.col("raw_idf") < 0, F.lit(eps)).otherwise(F.col("raw_idf")))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf): a term repeated in the query counts repeatedly."""
    return (queries.select(F.col(id_col).alias("query_id"),
                           F.explode(tokens(F.col(text_col))).alias("term"))
                   .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


SCORE_SCALE = 1e9   # impacts are kept as integers of 1e-9
BLOCK_CHUNKS = 64   # chunks of a block, about
SEED_TERMS = 3      # terms of a query that give the first floor
PRUNE_FROM_PAIRS = 10_000_000_000   # (query, chunk, term) rows of full scoring from which the search is pruned
PAIRS_PER_TASK = 500_000   # (query, chunk, term) rows, about, that one task sums
FLOOR_CHUNKS = 4096   # chunks, about, that are scored for a floor at least
FLOOR_SHARE = 16      # one chunk of so many is scored for a floor, where that leaves FLOOR_CHUNKS


@dataclass
class Pruned:
    """What a pruned search touches: (query, chunk, term) rows of its two scoring steps, and the final scores."""
    floors: DataFrame       # query_id, floor: a lower bound of the k-th best score
    essential: DataFrame    # postings of essential terms
    survivors: DataFrame    # chunks that can still be among the best, with their partial scores
    lookups: DataFrame      # postings of the other terms that survivors are asked for
    scores: DataFrame       # query_id, keys, total: exact scores of the survivors


class BM25Index:
    """Impact index of a chunked corpus.

    Built once: postings (with chunk length and section), idf, and per posting
    the query-independent impact idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl))
    as an integer multiple of 1e-9. A query's score is the sum of its terms'
    impacts times their repeat count: an exact integer sum, so equal chunks tie
    exactly whatever the summation order. The postings (one tokenization pass
    over the corpus) are materialized in the shared checkpoint folder.
    """

    def __init__(self, chunks: DataFrame, key_cols=("source", "section_no"),
                 k1: float = BM25_K1, b: float = BM25_B, materialized: bool = True):
        from kpiscope.session import materialize

        self.keys = list(key_cols)
        keep = materialize if materialized else (lambda df, _name: df)
        post = keep(postings(chunks, self.keys), "bm25_postings")
        self.lengths = post.select(*self.keys, "section", "dl")
        row = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total")).first()
        self.n_docs, total = int(row["n"]), int(row["total"] or 0)
        self.avgdl = (total / self.n_docs) if self.n_docs else 0.0
        # the outer form, since for the other Spark tests the array's size before it is made, by making it again
        # for each of its tokens where the postings are not materialized
        self.tf = (post.select(*self.keys, "dl", F.explode_outer("terms").alias("t")).where(F.col("t").isNotNull())
                   .select(*self.keys, "dl", "t.term", "t.tf"))
        raw = keep(idf_table(self.tf, self.n_docs), "bm25_idf")
        st = raw.agg(F.avg("raw_idf").alias("m")).first()
        self.eps = BM25_EPSILON * float(st["m"]) if st["m"] is not None else 0.0
        self.idf = final_idf(raw, self.eps)
        self.k1, self.b = k1, b

    def impact(self) -> Column:
        """idf * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)) of a posting, as an integer of 1e-9."""
        k1, b, one = F.lit(self.k1), F.lit(self.b), F.lit(1.0)
        t, avgdl = F.col("tf").cast("double"), F.lit(self.avgdl if self.avgdl else 1.0)
        norm = t * (k1 + one) / (t + k1 * (one - b + b * F.col("dl") / avgdl))
        scaled = F.col("idf") * norm * F.lit(SCORE_SCALE)
        # halves go away from zero; ``round`` takes every number through a decimal, so it is kept for negative ones
        return F.floor(scaled + F.lit(0.5)) if self.eps >= 0 else F.round(scaled).cast("bigint")

    def scores(self, queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
        """T4: score of every chunk sharing a term with the query (others score
        0 and never rank above a positive score). The query terms take their idf
        first, so the postings meet one table of query terms only; that table is
        broadcast when its bytes are measured small (a term in every chunk is
        then no hot key), else AQE splits hot terms."""
        return self._full(*self._query_side(queries, id_col, text_col))

    def _full(self, side: DataFrame, small: bool) -> DataFrame:
        return self._totals(self.tf, side, small).withColumn(
            "score", F.col("total").cast("double") / F.lit(SCORE_SCALE)).drop("total")

    def _totals(self, tf: DataFrame, side: DataFrame, small: bool, pairs: int | None = None) -> DataFrame:
        """(query_id, keys, total): scores of all pairs in units of 1e-9, from the postings ``tf``.

        The postings of query terms are dealt out by chunk before they meet the queries. What a query sums
        over a chunk is then in one task, and the pairs, many for each posting, are not shuffled. Where their
        number is known, it tells how many tasks sum them, so that a task's sums stay small at any size.
        """
        tasks = [] if pairs is None else [-(-pairs // PAIRS_PER_TASK) or 1]
        if small:
            hits = tf.join(F.broadcast(side.select("term", "idf").distinct()), "term")
            hits = hits.select(*self.keys, "term", self.impact().alias("impact")).repartition(*tasks, *self.keys)
            hits = hits.join(F.broadcast(side.select("query_id", "term", "qtf")), "term")
        else:
            hits = tf.join(side, "term").withColumn("impact", self.impact())
        return hits.groupBy("query_id", *self.keys).agg(F.sum(F.col("qtf") * F.col("impact")).alias("total"))

    def floors(self, side: DataFrame, small: bool, k: int, pairs: int) -> DataFrame | None:
        """(query_id, floor): the k-th best total among a share of the chunks, which the k-th best of all is not
        under; no row for a query with fewer there. None for a corpus so small that a share would tell nothing."""
        share = min(FLOOR_SHARE, self.n_docs // FLOOR_CHUNKS)
        if share < 2:
            return None
        some = self.tf.where(F.pmod(F.xxhash64(*self.keys), F.lit(share)) == 0)
        best = Window.partitionBy("query_id").orderBy(F.col("total").desc())
        return (self._totals(some, side, small, pairs // share).select("query_id", "total", F.row_number().over(best).alias("r"))
                .where(F.col("r") <= k).groupBy("query_id").agg(F.min("total").alias("floor"), F.count(F.lit(1)).alias("n"))
                .where(F.col("n") == k).drop("n"))

    def _best(self, side: DataFrame, small: bool, k: int, pairs: int) -> DataFrame:
        """Scores of the pairs that can be among a query's k best, ties included: those of ``_full`` from the floor on."""
        from kpiscope.session import materialize

        floors = self.floors(side, small, k, pairs)
        if floors is None:
            return self._full(side, small)
        floors = materialize(floors, "bm25_floors").withColumnRenamed("query_id", "floor_of")
        # null query ids are a group of their own, so they meet their floor too
        met = self._totals(self.tf, side, small, pairs).join(
            F.broadcast(floors) if small else floors, F.col("query_id").eqNullSafe(F.col("floor_of")), "left")
        return (met.where(F.col("total") >= F.coalesce("floor", "total"))
                .withColumn("score", F.col("total").cast("double") / F.lit(SCORE_SCALE)).drop("total", "floor_of", "floor"))

    def _query_side(self, queries: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
        """(query_id, term, qtf, idf, df) of indexed query terms, and whether that table may be broadcast."""
        qt = query_terms(queries, id_col, text_col)
        size = qt.agg(F.coalesce(F.sum(F.octet_length("term") + 40), F.lit(0))).first()[0]
        small = size <= BROADCAST_QUERY_BYTES
        return self.idf.select("term", "idf", "df").join(F.broadcast(qt) if small else qt, "term"), small

    def pruned(self, queries: DataFrame, k: int = RETRIEVAL_TOP_K, id_col: str = "query_id", text_col: str = "text",
               block_chunks: int = BLOCK_CHUNKS) -> Pruned:
        """Exact scores of every chunk that can be among a query's k best, ties included.

        Needs impacts of at least 0 (``eps`` not negative), so that a partial score is a lower bound.
        """
        from kpiscope.session import materialize

        side, small = self._query_side(queries, id_col, text_col)
        return self._pruned(materialize(side, "bm25_side"), small, k, block_chunks)

    def _pruned(self, side: DataFrame, small: bool, k: int, block_chunks: int = BLOCK_CHUNKS) -> Pruned:
        from kpiscope.session import materialize

        hint = F.broadcast if small else (lambda df: df)
        block = F.pmod(F.xxhash64(*self.keys), F.lit(max(1, -(-self.n_docs // block_chunks))))
        idf = side.select("term", "idf").distinct()
        hits = materialize(self.tf.join(hint(idf), "term").select(
            *self.keys, block.alias("block"), "term", self.impact().alias("impact")), "bm25_hits")
        blocks = materialize(hits.groupBy("term", "block").agg(F.max("impact").alias("most")), "bm25_blocks")
        bounds = blocks.groupBy("term").agg(F.max("most").alias("most"))
        terms = side.join(bounds, "term").select("query_id", "term", "qtf", (F.col("qtf") * F.col("most")).alias("bound"))
        place = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "term")      # the terms of one query text
        terms = terms.withColumn("place", F.row_number().over(place))

        def partial(of: DataFrame) -> DataFrame:
            met = hits.join(hint(of.select("query_id", "term", "qtf")), "term")
            return met.groupBy("query_id", *self.keys, "block").agg(F.sum(F.col("qtf") * F.col("impact")).alias("part"))

        def kth(parts: DataFrame) -> DataFrame:
            best = Window.partitionBy("query_id").orderBy(F.col("part").desc())
            return (parts.select("query_id", "part").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
                    .groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("part")).otherwise(0).alias("floor")))

        first = kth(partial(terms.where(F.col("place") <= SEED_TERMS)))
        # bounds of a term and of all terms with smaller ones
        below = Window.partitionBy("query_id").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
        terms = materialize(terms.join(first, "query_id", "left").withColumn(
            "essential", F.sum("bound").over(below) >= F.coalesce("floor", F.lit(0))).drop("floor", "place"), "bm25_essential")
        essential = terms.where("essential")
        others = terms.where(~F.col("essential"))
        parts = materialize(partial(essential), "bm25_parts")
        floors = kth(parts)
        rest = others.groupBy("query_id").agg(F.sum("bound").alias("rest"))
        near = (parts.join(hint(floors), "query_id").join(hint(rest), "query_id", "left")
                .where(F.col("part") + F.coalesce("rest", F.lit(0)) >= F.col("floor")))
        of_block = (blocks.join(hint(others.select("query_id", "term", "qtf")), "term")
                    .groupBy("query_id", "block").agg(F.sum(F.col("qtf") * F.col("most")).alias("block_rest")))
        survivors = materialize(
            near.join(of_block, ["query_id", "block"], "left")
            .where(F.col("part") + F.coalesce("block_rest", F.lit(0)) >= F.col("floor"))
            .select("query_id", *self.keys, "part"), "bm25_survivors")
        asked = survivors.join(hint(others.select("query_id", "term", "qtf")), "query_id").select("query_id", *self.keys, "term", "qtf")
        lookups = (hits.join(asked, ["term", *self.keys])
                   .select("query_id", *self.keys, (F.col("qtf") * F.col("impact")).alias("part")))
        scores = (survivors.unionByName(lookups).groupBy("query_id", *self.keys).agg(F.sum("part").alias("total")))
        return Pruned(floors, hits.join(hint(essential.select("query_id", "term")), "term"), survivors, lookups, scores)

    def top_k(self, queries: DataFrame, k: int = RETRIEVAL_TOP_K, id_col: str = "query_id",
              text_col: str = "text", prune_from: int = PRUNE_FROM_PAIRS) -> DataFrame:
        """T5: k best chunks per query, positive scores only, rounded to 4. Equal scores keep corpus order.

        The document frequencies tell exactly how many (query, chunk, term) rows full scoring would list.
        From ``prune_from`` of them on the search is pruned; below, one pass over the postings, whose pairs stay
        in the task of their chunk, costs less than the steps of the pruned search, and gives the same rows.
        Where the floor of the idf is negative (only in a corpus whose words are in most chunks), partial
        scores bound nothing and every pair is scored.
        """
        from kpiscope.session import materialize

        side, small = self._query_side(queries, id_col, text_col)
        side = materialize(side, "bm25_side")
        pairs = side.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        if self.eps < 0 or pairs < prune_from:
            s = self._best(side, small, k, pairs)
        else:
            s = self._pruned(side, small, k).scores.withColumn(
                "score", F.col("total").cast("double") / F.lit(SCORE_SCALE)).drop("total")
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *[F.col(c) for c in self.keys])
        r = s.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") > 0))
        # section names are attached to the few ranked rows only (not carried
        # through the scoring aggregate); the ranked side is the small one
        names = self.lengths.select(*self.keys, "section")
        return (r.join(names, self.keys)
                 .select("query_id", F.col("rank").cast("bigint").alias("rank"), *self.keys, "section",
                         round_to("score", 4).alias("relevance_score")))


def documents_as_chunks(docs: DataFrame) -> DataFrame:
    """The documents table as a corpus: one source per document."""
    return section_chunks(docs.select(F.col("doc_id").alias("source"), F.col("text").alias("value")))
