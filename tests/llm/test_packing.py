import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kpiscope.llm import packing as K
from kpiscope.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_file())


def whole_text_pieces(tokenizer, text, capacity=4096):
    ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    return [(k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes()))
            for k, at in enumerate(range(0, len(ids), capacity))]


@pytest.mark.parametrize("text", [
    "", " ", "Hello, world! it's we'll 123 a1b2", "ÄÖ ß İstanbul ΣΑΣ éa J̌", "a b c\td\r\ne",
    "<|endoftext|> x<|startoftext|>y", "word.,; word.' 'quoted' don't. \U0001F600‍½ ...", "trailing.\n\n.leading ,x",
    "日本語 テスト ₂x²", "ẞﬁx Å"])
def test_word_cache_equals_whole_text(tokenizer, text):
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert K.WordTokens(tokenizer_file())([text, text]) == [want, want]


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_table(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = K.pack(docs, tokenizer_file()).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for r in docs.collect():
        assert sorted(pieces[r["doc_id"]]) == whole_text_pieces(tokenizer, r["text"])
    bound = -(-sum(r["length"] for r in rows) // 4096)
    assert bound <= check_packing(rows, 4096) <= bound + 1


def test_odd_rows_and_shards(odd_docs, no_docs, tokenizer):
    rows = K.pack(odd_docs, tokenizer_file(), capacity=512, shard_pieces=3).collect()
    check_packing(rows, 512)
    assert sum(r["doc_id"] == 6 for r in rows) == 2 and [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    long = [r for r in rows if r["doc_id"] == 5]
    assert len(long) > 10 and all(r["length"] == 512 for r in long if r["piece"] < len(long) - 1)
    assert sum(r["doc_id"] is None for r in rows) == 1
    assert K.pack(no_docs, tokenizer_file()).count() == 0


def test_rows_that_repeat_spread_over_shards(spark):
    docs = spark.range(600).selectExpr("if(id % 3 = 0, 777, id) as doc_id", "if(id % 3 = 0, 'one text', repeat('two ', id % 50)) as text")
    rows = K.pack(docs, tokenizer_file(), capacity=64, shard_pieces=50)
    shards = [r["count"] for r in rows.where("doc_id = 777").selectExpr("shiftright(sequence_id, 24) as shard").groupBy("shard").count().collect()]
    assert sum(shards) == 200 and max(shards) < 50 and len(shards) >= 8
    check_packing(rows.collect(), 64)


def test_texts_are_numbered_in_bounded_parts(tokenizer):
    texts = ["Alpha, beta." * 50, "", "x " * 3000, "ä" * 500, "Alpha beta", ""]
    import pyarrow as pa
    assert list(K.parts_of(pa.array(texts), 1000)) == [(0, 2), (2, 3), (3, 6)]
    words = K.WordTokens(tokenizer_file())
    for lo, hi in K.parts_of(pa.array(texts), 1000):
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[lo:hi]]
        assert words(pa.array(texts).slice(lo, hi - lo)) == want


def test_word_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(K, "CACHE_WORDS", 5)
    words = K.WordTokens(tokenizer_file())
    for text in ("one two three four five six", "Seven, eight. one", "One TWO \u00dcber \u00fcber-all", "three nine's ten", "one"):
        assert words([text]) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_genetic_steps_keep_every_piece_once():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 300).astype(np.int32)
    a, b = K.first_packing(sizes, 100, None), K.first_packing(sizes, 100, rng)
    for child in (K.cross(sizes, a, b, 100, rng), K.mutate(sizes, a, 100, rng)):
        used = K.fills(sizes, child)
        assert len(child) == len(sizes) and used.max() <= 100 and (used > 0).all()


def test_evolution_improves_hard_sizes():
    # triplets that fill a bin exactly: largest-first best fit wastes bins on them
    rng = np.random.default_rng(4)
    first = rng.integers(26, 49, 60)
    second = np.array([rng.integers(26, 74 - f + 1) if f < 48 else 26 for f in first])
    sizes = np.concatenate([first, second, 100 - first - second]).astype(np.int32)
    start = [K.first_packing(sizes, 100, None)] + [K.first_packing(sizes, 100, rng) for _ in range(7)]
    before = max(K.fitness(sizes, p, 100) for p in start)
    after = K.evolve(sizes, start, 100, 60, rng)[0]
    assert K.fitness(sizes, after, 100) > before and after.max() <= start[0].max()
