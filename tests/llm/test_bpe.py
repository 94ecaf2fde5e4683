"""Forced-boundary encoding against the library, on odd and random texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citefold.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "  lead and  two", "tail \n\n", "x\u0085 y  z", "é é\n\n\tz", "<|endoftext|> foo  <|endoftext|>bar<|startoftext|>", "don't  it's 12 3\r\n5",
       "<|endoftext|", "<|EndOfText|>", "IT'S ''S 'rex a'b'c'll 1's2", "Σας ΣΑΣ", "日本 語　 x", "ﬁ ǅ İ ß a.b, c!d é. H̱",
       "word " * 3000, "a,b.c;d ... , .", "a" * 5000, "qzxj" * 1000, "≠ ≠ ≮ 1́ ́a", "\x1c\x1d a\x1eb\x00c​‍﻿ x"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Bpe(PATH)


def test_forced_pairs_are_those_of_no_token(vocabulary):
    names = Tokenizer.from_file(PATH).get_vocab(with_added_tokens=False)
    letters = bpe.byte_letters()
    seen = {(letters[a], letters[b]) for name in names for a, b in zip(name.removesuffix("</w>"), name.removesuffix("</w>")[1:])}
    assert {tuple(p) for p in np.argwhere(vocabulary.inside).tolist()} == seen


def test_ids_and_names_equal_the_library(vocabulary):
    rng = random.Random(4)
    near = "ab .,'\n\t  éÉsSTdlrev012!<|>endofxt-_̸́Kſ"
    wide = [range(0x20, 0x250), range(0x300, 0x370), range(0x2000, 0x2100), range(0x1F300, 0x1F650), range(0xAC00, 0xAD00)]
    texts = ODD + ["".join(rng.choices(near, k=rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice(rng.choice(wide))) for _ in range(30)) for _ in range(500)]
    tokenizer = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from memory
        body, bounds = vocabulary.encode(pa.array(texts))
        ids = np.frombuffer(body, "<u4")
        for i, text in enumerate(texts):
            expected = tokenizer.encode(text or "", add_special_tokens=False).ids
            got = ids[bounds[i]:bounds[i + 1]]
            assert got.tolist() == expected, text
            assert vocabulary.decode(got)[:-1].tobytes().decode() == tokenizer.decode(expected, skip_special_tokens=False)


def test_words_are_cut_at_forced_pairs_only(vocabulary):
    a, b = next((a, b) for a in range(97, 123) for b in range(97, 123) if not vocabulary.inside[a, b])
    word = ("th" + chr(a) + chr(b) + "ing") * 3
    ids = Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids
    assert np.frombuffer(vocabulary._words([word.encode()])[0], "<u4").tolist() == ids


def test_frames_keep_rows_and_columns(docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "null id")]
    source = docs(rows, 3)
    made = bpe.decode(bpe.encode(source, PATH), PATH)
    assert set(made.columns) == {"doc_id", "lang", "score", "n", "n_tokens", "ids", "decoded"} and made.count() == len(rows)
    tokenizer = Tokenizer.from_file(PATH)
    expected = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=repr)
    got = made.collect()
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr) == expected
    assert all(r.decoded == tokenizer.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) and r.n == 7 for r in got)
    assert bpe.decode(bpe.encode(docs([]), PATH), PATH).count() == 0
    clash = source.withColumnRenamed("text", "body").withColumnRenamed("lang", "text")
    assert sorted(bpe.encode(clash, PATH, "body").select("ids").collect()) == sorted(bpe.encode(source, PATH).select("ids").collect())


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
