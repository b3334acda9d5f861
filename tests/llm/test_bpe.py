"""Encoding, decoding and counting against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusq.llm import queries as Q
from corpusq.llm import simple8b
from corpusq.llm.bpe import bpe_decode, bpe_encode, codec, decoder
from corpusq.llm.token_count import Counter, token_count
from corpusq.llm.token_store import ChunkEncoder, read_tokens, write_tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "th", "e", " ", "  ", "\n", "ing", "'s", "'S", "1", "9", "é", "É", "ß", "!", "?", "\t", "<|endoftext|>", "的", "🤣", "\x1e", "\xa0", "Σ", "́", "İ", "\x01"]


def odd_texts():
    rng = random.Random(1)
    fixed = ["", " ", "\n", "a  b\n\n c", "it's we'll", "<|endoftext|>x<|endoftext|>", "a" * 3000, "ab" * 500 + " " * 40 + "z", "the\r\nend ", "x\x85y", "123 ١٢"]
    return fixed + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_byte_codec_equals_library():
    t, c = Tokenizer.from_file(BYTE), codec(BYTE)
    count = Counter(c.v)
    for text, ids in zip(odd_texts(), c.encode(odd_texts())):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoder(BYTE)(ids) == t.decode(want, skip_special_tokens=False)
        assert sum(map(count.__getitem__, c.v.units(text))) == len(want)


def test_every_character_between_neighbours():
    """Each code point after and before others that merge with its bytes."""
    t, c = Tokenizer.from_file(BYTE), codec(BYTE)
    count = Counter(c.v)
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    rng = random.Random(2)
    near = ["a", "é", "\u9812", "1", "!", "的"]
    for first in range(0, len(points), 4000):
        text = " ".join(rng.choice(near) + chr(p) + rng.choice(near) for p in points[first : first + 4000])
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(c.encode([text])[0], "<u4").tolist() == want
        assert sum(map(count.__getitem__, c.v.units(text))) == len(want)
    odd = "\U00018cda\u9812"
    assert np.frombuffer(c.encode([odd])[0], "<u4").tolist() == t.encode(odd, add_special_tokens=False).ids


def test_proposals_are_verified():
    """Words whose greedy tokens are not what merging gives are merged exactly."""
    c = codec(BYTE)
    words = ["".join(p) for p in zip("thonating" * 20, "erstinghe" * 20)] + ["ingthere", "thetion", "ononere"]
    c.forget()
    differs = sum(c.propose(w.encode()) != c.merge(w.encode()) for w in words)
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in c.encode(words)] == [c.merge(w.encode()) for w in words]
    assert differs > 0


def test_word_encoder_equals_library():
    t, e = Tokenizer.from_file(WORD), ChunkEncoder(WORD)
    for text, ids in zip(odd_texts(), e.encode(odd_texts())):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 4000])
@pytest.mark.parametrize("top", [0, 1, 50_000, 2**59, 2**60, 2**64 - 1])
def test_simple8b_round_trip(n, top):
    v = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True)
    assert (simple8b.decode(simple8b.encode(v)) == v).all()


def test_token_store(spark, tmp_path):
    rows = [(5, "Hello there"), (2, None), (None, "x"), (9, ""), (2, "again and again"), (2, "again and again")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    write_tokens(df, str(tmp_path / "s"), WORD, 1)
    got = read_tokens(spark, str(tmp_path / "s")).orderBy("start").collect()
    t = Tokenizer.from_file(WORD)
    start = 0
    assert [r.doc_id for r in got] == [None, 2, 2, 2, 5, 9]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    by = {(r.doc_id, bytes(r.ids)) for r in got}
    assert by == {(d, struct.pack(f"<{len(i)}I", *i)) for d, i in ((d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in rows)}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(none, str(tmp_path / "e"), WORD, 1)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0
    assert bpe_decode(bpe_encode(none, BYTE), BYTE).count() == 0
    assert token_count(none, BYTE).count() == 0


def test_special_strings_made_by_case_and_unknown_characters():
    t, e = Tokenizer.from_file(WORD), ChunkEncoder(WORD)
    texts = ["<|ENDOFTEXT|> x", "a<|EndOfText|>b <|endoftext|>", "<|STARTOFTEXT|>", *(f"a{chr(c)}B 1{chr(c)} {chr(c)}\u00cb" for c in (0x558, 0x88F, 0xC5C, 0x1C89, 0xA7CB, 0x10D50, 0x1E5D0, 0xE000, 0x2FE0))]
    texts += [f"x{chr(c)}Y {chr(c)}9" for c in range(0x80, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(texts, e.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_latin_texts_are_cut_as_arrays(monkeypatch):
    """Ids are the library's, and no word of a Latin text is looked at on its own."""
    t, e, slow = Tokenizer.from_file(WORD), ChunkEncoder(WORD), []
    monkeypatch.setattr(ChunkEncoder, "__missing__", lambda self, chunk, f=ChunkEncoder.__missing__: slow.append(chunk) or f(self, chunk))
    rng = random.Random(4)
    texts = ["It's I'LL we've they'RE ''s ,'s a's's 'd'm 't\n", "", "'", "l", "'", "re", "été,&&& ÀÖØÞß ÿ12 3é4\x00\x1c\x7f $$$a"]
    texts += ["".join(rng.choice("''''strevlmdaE É9 ,\n\x0b\x1c!") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert [list(memoryview(x).cast("I")) for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert not slow
    mixed = ["a×b", "it's", "x÷", "“it's”", "", "e\u0301", "<|endoftext|>", "naïve²", "日本", "ok"]
    part = pa.array(["skip", *mixed])[1:]
    assert [list(memoryview(x).cast("I")) for x in e.encode_column(part)] == [t.encode(x, add_special_tokens=False).ids for x in mixed]


def test_odd_rows_and_clashes(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "it's"), (5, "<|endoftext|>"), (6, "word " * 30000)]
    d = spark.createDataFrame([(*r, "old", "old", 1) for r in rows], "doc_id long, text string, IDS string, decoded string, n_tokens int")
    t = Tokenizer.from_file(BYTE)
    coded = bpe_encode(d, BYTE, keep=["doc_id", "text", "IDS", "decoded", "n_tokens"])
    assert coded.columns == ["doc_id", "text", "decoded", "n_tokens", "ids"]
    back = bpe_decode(coded, BYTE)
    assert back.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"] and all(r.decoded == (r.text or "") for r in back.collect())
    both = bpe_encode(d, BYTE, keep=["doc_id", "decoded"], decoded="decoded").collect()
    assert sorted(r.decoded for r in both) == sorted(x or "" for _, x in rows)
    counted = token_count(d, BYTE, keep=["doc_id", "text", "n_tokens"])
    assert counted.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"] and counted.count() == len(rows)
    assert all(r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids) for r in counted.collect())


def test_memory_is_bounded(monkeypatch):
    from corpusq.llm import bpe, token_store

    monkeypatch.setattr(bpe, "REMEMBERED", 3000)
    monkeypatch.setattr(token_store, "REMEMBERED", 3000)
    c, e, t = bpe.Codec(BYTE), ChunkEncoder(WORD), Tokenizer.from_file(BYTE)
    rng = random.Random(9)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(40))
        assert np.frombuffer(c.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        e.encode([text])
        assert len(c.known) < 120 and len(c.older) < 120 and len(e) < 120 and len(e.old) < 120


def test_queries(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t, w = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for r in Q.op6_bpe_codec(spark, sf).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in Q.op4_token_count(spark, sf).collect():
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)
    start = 0
    for r in sorted(Q.op1_token_store(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = [*w.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
