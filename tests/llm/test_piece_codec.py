import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tidewheel.llm import piece_codec

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.load_vocabulary(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_every_character_of_a_piece_is_a_piece(codec):
    assert all(c in codec.ids for p in codec.ids for c in p)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "  a   b    ", " " * 40 + "日  日", "a\n\n\tb\r\n", "▁a▁▁b", "<s></s><unk><0x41>", "日本語😀😀é́", "\x00\x7f​﻿￿", "x" * 3000, "١٢٣ कखग ꙮ" * 50])
def test_like_the_library(codec, library, text):
    ids = codec.encode(text).tolist()
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids)


def test_random_texts_like_the_library(codec, library):
    rng = random.Random(7)
    letters = "aabcdeeéèêñöüßthinor  \n.,'\"0123456789@+-_<>|▁日本ꙮ😀"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text), repr(text)
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("n", range(1, 70))
def test_runs_of_blanks(codec, library, n):
    assert codec.encode(" " * n + "the").tolist() == library.encode(" " * n + "the")
    assert codec.encode(" " * n).tolist() == library.encode(" " * n)


def test_long_texts_and_small_tables(codec, library, monkeypatch):
    small = piece_codec.Codec(piece_codec.load_vocabulary(MODEL))
    small.known.most = small.pairs.most = 50
    monkeypatch.setattr(piece_codec, "AT_ONCE", 100)
    text = "Some words,  and more words;\n" * 300 + "x1y2z3" * 500
    assert small.encode(text).tolist() == library.encode(text)
    assert max(len(small.known), len(small.known.before), len(small.pairs)) <= 50


def test_models_of_other_kinds_are_refused(monkeypatch):
    monkeypatch.setattr(piece_codec.Codec, "blanks", lambda self, n: (self.ids[piece_codec.BLANK],) * n)
    with pytest.raises(ValueError, match="another way"):
        piece_codec.load_vocabulary(MODEL)


def test_encode_and_decode_apart_are_encode_with_both(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, None), (3, "é😀")], "doc_id long, text string")
    apart = piece_codec.decode(piece_codec.encode(df, MODEL), MODEL)
    assert apart.collect() == piece_codec.encode(df, MODEL, decoded="decoded").collect()
    assert [r.decoded for r in piece_codec.decode(apart.selectExpr("doc_id", "cast(null as array<int>) as ids"), MODEL).collect()] == ["", "", ""]


def test_frame(spark, library):
    texts = [(1, "the cat\nsat", "x"), (2, None, "y"), (3, "", None), (4, "long " * 20_000, "z"), (4, "long " * 20_000, "z"), (None, "é😀", "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, extra string")
    rows = piece_codec.digests(df, MODEL).collect()
    want = []
    for d, t, _ in texts:
        ids = library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert piece_codec.digests(df.limit(0), MODEL).collect() == []
    assert set(piece_codec.encode(df, MODEL).columns) == {"doc_id", "extra", "ids"}
    with pytest.raises(ValueError):
        piece_codec.encode(df.withColumn("IDS", df.doc_id), MODEL)
