from kpiscope.llm import license_scan as L
from kpiscope.llm import url_filter as U
from kpiscope.llm.queries import URL_RULES


def test_shunting_yard_orders_and_evaluates():
    rpn = L.to_postfix("( mit or gpl-3.0 ) and apache-2.0".split())
    assert rpn == ["mit", "gpl-3.0", "or", "apache-2.0", "and"]
    assert L.restriction(rpn) == 0.2
    assert L.to_postfix("mit or".split()) is None and L.to_postfix("( mit".split()) is None
    soft = L.restriction(L.to_postfix("gpl-2.0 with classpath-exception-2.0".split()))
    assert abs(soft - 0.4) < 1e-9


def test_scan_finds_base_places_tags_and_notices():
    n, n_base, first, last, base, labels, score = L.scan(
        "All rights reserved! cc BY\ncc-by x. Licensed under the Apache License,\nVersion 2.0")
    assert (n, n_base, first, last, base) == (16, 3, 0, 5, "cc-by,reserved")
    assert labels == "apache-2.0,cc-by,reserved" and score == 1.0
    got = L.scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */\n")
    assert got[5] == "apache-2.0,gpl-2.0-only,mit" and got[6] == 0.2
    assert L.scan("under the MIT License or Apache License 2.0")[6] == 0.1
    assert L.scan("") == (0, 0, None, None, "", "", 0.0)


def test_license_scan_rows(odd_docs, no_docs):
    out = {(r["doc_id"], r["n_words"]) for r in L.license_scan(odd_docs).collect()}
    assert len(L.license_scan(odd_docs).collect()) == 9 and (5, 18000) in out and (2, 0) in out
    assert L.license_scan(no_docs).count() == 0


def test_base_columns_against_brute_force(spark, sf_small):
    import re
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in L.license_scan(docs).collect():
        words = word.findall(texts[r["doc_id"]].translate({c: c + 32 for c in range(65, 91)}))
        places = [i for p in L.BASE_PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min(places, default=None) and r["last_word"] == max(places, default=None)


def brute_rule(host, path):
    fits = [(len(t), t, v) for v, t in URL_RULES
            for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_viterbi_splits_concatenated_names():
    counts = {"free": 50, "bets": 50, "casino": 40, "win": 30, "a": 900}
    assert U.viterbi("freebets", counts, 2000) == ["free", "bets"]
    assert U.viterbi("casinowinx", counts, 2000) == ["casino", "win", "x"]
    assert U.viterbi("zzqqkk", counts, 2000) == ["zzqqkk"]


def test_urls(spark):
    urls = ["http://A.Example.org/es/1?x", "https://example.org/en/12#a", "http://x.org", "ftp://q.com/fr/", None, "no url", "",
            "http://freebets.example.net/x", "http://cheappillsonline.example.net/", "http://citylibrary.example.net/news",
            "http://com/de/", "http://example.org/es/1://z", "http://myorg/", "http://" + "a" * 3000 + ".net/" + "b/" * 2000]
    rows = [(i, u, "html", "h", 1.0) for i, u in enumerate(urls)] + [(None, urls[0], "html", "h", 1.0), (0, urls[0], "html", "h", 1.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, score double")
    got = U.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is None:
            continue
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:n].translate({c: c + 32 for c in range(65, 91)})
        path = rest[n:].split("?")[0].split("#")[0]
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = brute_rule(host, path)
        assert r["rule"] == rule and (rule is None or r["verdict"] == verdict)
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert verdicts[7] == "block" and verdicts[8] == "block" and verdicts[9] == "allow" and verdicts[4] == "allow"
    assert U.judge_urls(pages.where("1=0"), URL_RULES).count() == 0


def test_words_of_any_length(spark):
    long = "internationalizations"
    urls = [f"http://{long}-x.org/", f"http://free{long}casino.org/", "http://casino" + "qzxj" * 6 + ".org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = U.host_and_path()
    got = {r["piece"]: r["words"] for r in U.segmented_pieces(pages.select(host.alias("host"), path.alias("path"))).collect()}
    assert got[long] == [long] and got[f"free{long}casino"] == ["free", long, "casino"]
    assert got["casino" + "qzxj" * 6] == ["casino", "qzxj" * 6]
    assert U.viterbi("qzxj" * 10, {}, 1000) == ["qzxj" * 10]


def test_split_equals_all_spans():
    import math
    import random
    def plain(piece, counts, total):
        best = [(0.0, [])]
        for end in range(1, len(piece) + 1):
            def cost(start):
                size = end - start
                n = counts.get(piece[start:end], 0) if size > 1 or size == len(piece) else 0
                return best[start][0] + (math.log(n / total) if n else math.log(10 / total) - size * math.log(10))
            best.append((max(map(cost, range(end))), None))
        return best[-1][0]
    def cost_of(words, piece, counts, total):
        return sum(math.log(n / total) if (n := counts.get(w, 0) if len(w) > 1 or w == piece else 0)
                   else math.log(10 / total) - len(w) * math.log(10) for w in words)
    rng = random.Random(2)
    for _ in range(300):
        words = ["".join(rng.choices("abc", k=rng.randint(1, 20))) for _ in range(8)]
        counts = {w: rng.randint(1, 50) for w in words[:6]}
        piece = "".join(rng.choices(words, k=rng.randint(1, 5)))
        got = U.viterbi(piece, counts, 500)
        assert "".join(got) == piece and abs(cost_of(got, piece, counts, 500) - plain(piece, counts, 500)) < 1e-9


def test_one_long_text_is_scanned_in_linear_time():
    import time
    start = time.time()
    n, n_base, first, last = L.scan("cc by " * 100_000)[:4]
    assert (n, n_base, first, last) == (200_000, 100_000, 0, 199_998)
    for text in ("word " * 100_000, "(" * 300_000, "mit or " * 50_000, "(mit) " * 50_000):
        L.scan("SPDX-License-Identifier: mit " + text)
    assert time.time() - start < 30


def test_longest_expression_equals_dropping_from_the_end():
    import itertools
    for size in range(7):
        for tokens in itertools.product(("(", ")", "or", "mit"), repeat=size):
            left = list(tokens)
            while left and L.to_postfix(left) is None:
                left.pop()
            assert L.longest_expression(list(tokens)) == left
