import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from reelforge.llm import piece_bpe
from reelforge.llm.queries import digests

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return piece_bpe.PieceModel(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    out = ["", " ", "  ", "a", " a", "a ", "\n", "\n\n", " \n ", "a \nb", "a\n b", "▁", "x▁y ▁", "</s> <s> <unk> <0x41>", "\x00 a\x00", "\U0001f600́ é", "﻿​\r\n\t", "the the they there"]
    out += [" " * n for n in (3, 7, 15, 16, 17, 33, 100)] + ["a" * 50, "ab" * 40, "hehehethethe" * 5, "=" * 77, "-" * 40 + " x"]
    alphabets = ["abcdefghij ", "the on in er re   \n", "éèçà eau", "中文字 あい", "01 .,;-_/=+", "\U0001f600\U0001f601ab "]
    for _ in range(300):
        out.append("".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 120))))
    for _ in range(60):
        out.append("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x2500, 0x2600), rng.randint(0xE000, 0x1FFFF)])) for _ in range(40)))
    return out


def test_equals_library(model, library):
    for text in texts():
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids, repr(text)
        assert model.decode(ids) == library.decode(ids), repr(text)


def test_window_rounds_equal_rounds(model, monkeypatch):
    sample = [t for t in texts() if t]
    rounds = [model.encode(t) for t in sample]
    monkeypatch.setattr(piece_bpe, "LONG", 2)
    assert [model.encode(t) for t in sample] == rounds


def test_long_words(model, library):
    rng = random.Random(4)
    glued = "".join(rng.choices([p for p in model.pieces if p.isalpha()], k=5000))
    base = ["".join(rng.choices(letters, k=20_000)) for letters in ("ABCDEFGHabcdefgh0123456789+/", "etaoinshr", "et", "的一是不了", "a\U0001f600é")]
    for text in (" " * 5000, "ab" * 3000, "aaab" * 3000, "=" * 50_001, "theyre" * 900, "中文" * 2000, glued, *base):
        assert model.encode(text) == library.encode(text, add_eos=True)


def test_query(spark, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE", 50)
    rows = [(i, t, t) for i, t in enumerate([*texts(), None])] + [(0, "", "")]
    got = digests(piece_bpe.tokenise(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH))
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        want.append((i, len(ids), *sha))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert piece_bpe.tokenise(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
