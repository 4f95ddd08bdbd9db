import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kpiscope.llm import window_packing as W
from kpiscope.llm.queries import byte_tokenizer_file


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(byte_tokenizer_file())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [W.END_ID], "<u4")


@pytest.mark.parametrize("text", [
    "", " ", "Hello, world! it's we'll 123 a1b2", "ÄÖ ß İstanbul ΣΑΣ éa J̌  \n\n x", "a b c\td\r\ne   ",
    "<|endoftext|> x<|endoftext|>y", "\x1c x\x85y", "日本語 テスト ₂x² \U0001F600‍½",
    "ab" * 4000, " " * 5000 + "x", "x " * 700 + "y" * 3000, "\n" * 2500])
def test_rank_form_equals_the_tokenizer(tokenizer, text):
    want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
    assert np.array_equal(W.ByteTokens(byte_tokenizer_file())(text), want)


def test_a_long_run_takes_linear_time():
    assert len(W.ByteTokens(byte_tokenizer_file())("qx" * 300_000)) > 1000


def naive_best_fit(lengths, capacity):
    rooms, place = [], []
    for n in lengths:
        fits = [(room, w) for w, room in enumerate(rooms) if room >= n]
        if fits:
            tight = min(room for room, _ in fits)
            place.append((tight, n))
            rooms[next(w for room, w in fits if room == tight)] -= n
        else:
            place.append((capacity, n))
            rooms.append(capacity - n)
    return place, sorted(rooms)


@pytest.mark.parametrize("capacity,seed", [(8, 1), (64, 2), (1024, 3), (1024, 4)])
def test_segment_tree_finds_the_tightest_window(capacity, seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, capacity - 1) for _ in range(400)), reverse=True)
    window, offset = W.best_fit_decreasing(np.array(lengths), capacity)
    want, rooms = naive_best_fit(lengths, capacity)
    assert [(capacity - o, n) for o, n in zip(offset.tolist(), lengths)] == want
    assert sorted(capacity - np.bincount(window, weights=lengths).astype(int)) == rooms


def check(rows, docs, tokenizer, capacity):
    """Every id in exactly one piece, sequences gapless; returns padding and tokens."""
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    fills = []
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        fills.append(at)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert set(texts) == set(pieces)
    for doc_id, found in texts.items():
        ids = ids_of(tokenizer, found[0])       # rows that repeat an id repeat its text here
        n = len(found)
        cover = np.zeros(len(ids) + 1, int)
        for r in pieces[doc_id]:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            cover[r["start"]] += 1
            cover[r["start"] + r["length"]] -= 1
        assert (np.cumsum(cover)[:-1] == n).all()
    return sum(0 if f & (f - 1) == 0 else capacity - f for f in fills), sum(fills)


def test_table(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    padding, tokens = check(W.pack_windows(docs, byte_tokenizer_file()).collect(), docs, tokenizer, 1024)
    assert padding <= 0.01 * tokens


@pytest.mark.parametrize("shard_pieces", [3, 1000])
def test_odd_rows(odd_docs, no_docs, tokenizer, shard_pieces):
    rows = W.pack_windows(odd_docs, byte_tokenizer_file(), 256, shard_pieces).collect()
    padding, tokens = check(rows, odd_docs, tokenizer, 256)
    assert padding <= 0.02 * tokens
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1
    assert W.pack_windows(no_docs, byte_tokenizer_file()).count() == 0


def test_many_documents_of_one_awkward_length(spark, tokenizer):
    """Two of them never share a window; cutting keeps the padding away, and no shard gets all the copies."""
    text = "word " * 600
    docs = spark.range(300).selectExpr("if(id % 3 = 0, 7, id) as doc_id", f"'{text}' as text")
    rows = W.pack_windows(docs, byte_tokenizer_file(), 1024, 20).collect()
    padding, tokens = check(rows, docs, tokenizer, 1024)
    assert padding <= 0.01 * tokens
    dealt = W.pieces_of(docs, byte_tokenizer_file()).selectExpr("monotonically_increasing_id() as number")
    sizes = [r["count"] for r in dealt.selectExpr("pmod(xxhash64(number), 15) as shard").groupBy("shard").count().collect()]
    assert max(sizes) < 3 * 20


def test_ids_beyond_double_precision_beside_a_null(spark):
    big = 2 ** 62 + 1
    docs = spark.createDataFrame([(big, "one"), (None, "two")], "doc_id long, text string")
    assert {r["doc_id"] for r in W.pack_windows(docs, byte_tokenizer_file()).collect()} == {big, None}


def test_capacity_must_be_a_power_of_two(odd_docs):
    with pytest.raises(ValueError):
        W.pack_windows(odd_docs, byte_tokenizer_file(), 1000)
