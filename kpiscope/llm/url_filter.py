"""URL filter: host word segmentation by unigram Viterbi, then multinomial naive Bayes.

A list of rules decides first (longest fitting rule). Every url also gets a
verdict of its own: host labels are cut at hyphens and digits, each remaining
concatenated piece is split into words by Viterbi under a unigram model, and a
multinomial naive Bayes over the words of host and path says allow or block.

The unigram counts cover all urls of the table: words that urls themselves set
apart (pieces of hyphenated labels, path words) plus the labelled names below.
They stay a Spark table: each distinct piece is expanded into its substrings,
which meet the counts in an equi-join, and one small Viterbi runs per piece. No
vocabulary is broadcast. Pieces are distinct before the expansion, so a host
with a third of all urls is segmented once.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule, and the verdict of an empty word list. Repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: labelled names for the naive Bayes, as words ----
BLOCK_NAMES = (
    "casino win", "online casino", "casino bonus", "free bets", "sports bets", "best bets", "lucky slots",
    "poker room", "jackpot slots", "cheap pills", "buy pills", "diet pills", "pharmacy pills online",
    "cheap meds", "spam farm", "link farm", "content farm", "ads track", "ad tracker", "track click",
    "click ads", "pop ads", "banner ads", "adult x", "adult video", "adult cams", "sex cams", "hot sex", "x rated",
    "porn tube", "free porn", "free win", "win prize", "win cash", "fast cash loan", "payday loan",
    "crack warez", "warez download", "torrent crack", "malware download", "phishing login", "replica watches",
)
ALLOW_NAMES = (
    "daily news", "city news", "news today", "tech blog", "science blog", "travel blog", "cooking blog",
    "history book", "book review", "open library", "public library", "city library", "school math",
    "university press", "health guide", "garden guide", "music school", "art museum", "city museum",
    "weather today", "open source", "code review", "software guide", "wiki page", "world wiki", "data science",
    "sports news", "football club", "family recipes", "film review", "photo archive", "science journal",
    "nature journal", "help center", "support forum", "community forum", "home page", "about", "article", "index",
)
# words of addresses that say nothing about a page
PLAIN_WORDS = frozenset("www m blog http https html htm php com org net example co uk de fr es en it index".split())
# ---- end of fixed values ----

HEAD = 16               # letters by which pieces meet words; longer words meet them by their first ones
SEED_WEIGHT = 50        # occurrences that a labelled name counts for in the unigram model
BLOCK_PRIOR = 0.2


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Lower-cased host and the path up to ``?`` or ``#``; empty without ``://``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_extract(u, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits. Rules are (verdict, 'host/path')."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def class_weights() -> tuple[dict[str, float], float]:
    """Log odds (block over allow) of each labelled word, and of the prior; unseen words weigh nothing."""
    block = Counter(w for name in BLOCK_NAMES for w in name.split())
    allow = Counter(w for name in ALLOW_NAMES for w in name.split())
    words = set(block) | set(allow)
    nb, na = sum(block.values()) + len(words), sum(allow.values()) + len(words)
    odds = {w: math.log((block[w] + 1) / nb) - math.log((allow[w] + 1) / na) for w in words}
    return odds, math.log(BLOCK_PRIOR / (1 - BLOCK_PRIOR))


def _words_of(column: Column) -> Column:
    """Runs of lower-case letters."""
    return F.filter(F.split(F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                            r"[^\p{Ll}]+"), lambda w: w != "")


def unigram_counts(urls: DataFrame) -> DataFrame:
    """``word, n`` over all urls: words that hosts and paths set apart, and the labelled names."""
    spark = urls.sparkSession
    labels = F.filter(F.split("host", r"\."), lambda p: F.instr(p, "-") > 0)
    own = urls.select(F.explode(F.concat(F.flatten(F.transform(labels, _words_of)), _words_of(F.col("path")))).alias("word"))
    seeds = Counter(w for name in (*BLOCK_NAMES, *ALLOW_NAMES, *sorted(PLAIN_WORDS)) for w in name.split())
    extra = spark.createDataFrame([(w, n * SEED_WEIGHT) for w, n in sorted(seeds.items())], "word string, n long")
    return (own.groupBy("word").agg(F.count("*").alias("n"))
            .unionByName(extra).groupBy("word").agg(F.sum("n").alias("n")))


def viterbi(piece: str, counts: dict[str, int], total: int) -> list[str]:
    """Likeliest split of a piece. An unknown word of k letters counts 10 / 10^k times, so a run
    that holds no known words stays whole; one known letter alone is no word inside a longer piece."""
    best, back = [0.0] + [-math.inf] * len(piece), [0] * (len(piece) + 1)
    longest = max(map(len, counts), default=0)
    apart = 0                                   # where the likeliest unknown word starts, whatever its end
    for end in range(1, len(piece) + 1):
        if best[end - 1] + (end - 1) * math.log(10) > best[apart] + apart * math.log(10):
            apart = end - 1
        starts = range(max(0, end - longest), end)
        for start in (apart, *starts) if apart < starts.start else starts:
            size = end - start
            n = counts.get(piece[start:end], 0) if start in starts and (size > 1 or size == len(piece)) else 0
            if not n and start != apart:
                continue
            p = best[start] + (math.log(n / total) if n else math.log(10 / total) - size * math.log(10))
            if p > best[end]:
                best[end], back[end] = p, start
    words: list[str] = []
    end = len(piece)
    while end:
        words.append(piece[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented_pieces(urls: DataFrame) -> DataFrame:
    """``piece, words``: each distinct letter run of a host, split into words."""
    pieces = urls.select(F.explode(_words_of(F.col("host"))).alias("piece")).distinct()
    counts = unigram_counts(urls)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    at = F.sequence(F.lit(1), F.length("piece"))
    spans = pieces.select("piece", F.explode(at).alias("start")).select(
        "piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.length("piece") - F.col("start") + 1)))
        .alias("size"), "start")
    known = (spans.select("piece", F.substring(F.col("piece"), F.col("start"), F.col("size")).alias("head")).distinct()
             .join(counts.withColumn("head", F.substring("word", 1, HEAD)), "head")
             .where(F.col("piece").contains(F.col("word"))).groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known")))
    n_all = total.first()["total"]

    @F.pandas_udf("array<string>")
    def split(piece: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([viterbi(p, {k["word"]: k["n"] for k in ([] if ks is None else ks)}, n_all)
                          for p, ks in zip(piece, known)])

    return pieces.join(known, "piece", "left").select("piece", split("piece", "known").alias("words"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row; score is the probability of block."""
    host, path = host_and_path()
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    odds, prior = class_weights()
    weight = F.create_map(*[F.lit(v) for w in sorted(odds) if w not in PLAIN_WORDS for v in (w, odds[w])])

    def log_odds(words: Column) -> Column:
        return F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(F.element_at(weight, w), F.lit(0.0)))

    hosts = (urls.select("host").distinct().select("host", F.explode(_words_of(F.col("host"))).alias("piece"))
             .join(segmented_pieces(urls), "piece").groupBy("host")
             .agg(F.sum(log_odds(F.col("words"))).alias("host_odds"), F.flatten(F.collect_list("words")).alias("host_words")))
    rule, says = rule_column(rules, F.col("host"), F.col("path"))
    z = F.lit(prior) + F.coalesce("host_odds", F.lit(0.0)) + log_odds(_words_of(F.col("path")))
    return (urls.join(hosts, "host", "left")
            .select("page_id", "host", "path", rule.alias("rule"), says.alias("_says"),
                    (F.lit(1.0) / (1 + F.exp(-z))).alias("score"),
                    F.array_join(F.array_sort(F.coalesce("host_words", F.array().cast("array<string>"))), " ").alias("host_words"))
            .withColumn("verdict", F.coalesce("_says", F.when(F.col("score") > 0.5, "block").otherwise("allow")))
            .drop("_says"))
