"""BPE (1) against the tokenizers library."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

from inspectkit.llm import bpe

from . import data

PATH = bpe.vocabulary_path()


def test_every_code_point():
    codec, lib = bpe.codec(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    for start in range(1, 0x3000, 7):
        text = "".join(f"Ab{chr(c)}'S c{chr(c)} " for c in range(start, start + 7) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_special_and_odd_texts():
    codec, lib = bpe.codec(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    for text in ("", "  ", " <|endoftext|>x<|startoftext|>", "a<|endoftext|>b <| ", "ΑΣ ΣΑΣ", "İstanbul", "é ́a", "x" * 5000, "don't we'll!!'s '''re", "\x1ca\x1fb"):
        ids = codec.encode(text)
        want = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_table_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    text = "one two three four five six one two"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert len(codec.words) <= 3


def test_edge_rows(spark):
    df, lib = data.documents(spark), Tokenizer.from_file(PATH)
    want = []
    for d, t in data.pairs(df):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        out = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(bpe.encode(df, PATH)).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encode(data.empty(spark), PATH).collect() == []
