import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beaconframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(library, text):
    ids = bpe.Encoder(PATH, {})([text])[0]
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert bpe.decode(ids, PATH).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "  ", "Hello  World's 123é́", "a<|startoftext|>b <|endoftext|>", "ΟΔΟΣ ΣΑΣ İstanbul ẞ", "x\x1cy\x85z​\x00", "日本語 ﬁ ½ ²", "<|endoftext", "😀👨‍👩‍👧", "'ll 'LL it's", "﻿　q", "ǅ Å"])
def test_equals_the_library(library, text):
    check(library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(library, text):
    check(library, text)


def test_table(spark, library):
    texts = [None, "", "The cat's <|endoftext|> hat", "The cat's <|endoftext|> hat", "rare wörds", "long text " * 20_000]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.bpe_digests(df, PATH).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        row = got[i if i != 3 else None]
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    ids = bpe.encode_documents(df, PATH)
    back = {r.doc_id: r.text for r in bpe.decode_documents(ids, PATH).collect()}
    assert back[4] == library.decode(library.encode(texts[4], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.bpe_digests(df.limit(0), PATH).collect() == []


def test_words_are_not_normalised_and_split_again(library):
    ids = lambda word: np.frombuffer(bpe.encode_words([word], PATH)[0], "<u4").tolist()
    assert ids("hello") == library.encode("hello", add_special_tokens=False).ids
    assert ids("HELLO") != ids("hello") and ids("a b") != ids("a") + ids("b")


def test_frequent_words_come_from_the_table(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "a c")], "doc_id long, text string")
    assert [r.word for r in bpe.word_table(df, PATH).collect()] == ["a"]
