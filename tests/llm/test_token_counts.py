import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from beaconframe.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, scores, byte_fallback):
    t = Tokenizer(models.Unigram(list(zip(pieces, scores, strict=True)), 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t


@pytest.fixture(scope="module")
def full():
    pieces, scores = tc.vocabulary(PATH)
    return library(pieces, scores, True), tc.Counter(pieces, scores)


def ours(counter, text):
    n, values = tc.stretches(pa.array([text]))
    return sum(counter.counts(values.to_pylist()))


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "Hello wörld\nand▁more", "日本語 ☃ \U0001f600x", "<s> <0x0A> </s>", "a" * 300, "\t\t x", "▁"])
def test_equals_the_library(full, text):
    assert ours(full[1], text) == len(full[0].encode(text).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdé ▁\n日x"), max_size=40))
def test_random_texts(full, text):
    assert ours(full[1], text) == len(full[0].encode(text).ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab▁"), min_size=1, max_size=4), st.integers(-9, 0)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.text(st.sampled_from("abc "), max_size=25))
def test_ties_and_unknown_letters_of_any_vocabulary(words, text):
    pieces, scores = ["?", *(w for w, _ in words)], [0.0, *(float(s) for _, s in words)]
    assert ours(tc.Counter(pieces, scores), text) == len(library(pieces, scores, False).encode(text).ids)


def test_table(spark):
    rows = [(1, "a b", 7), (None, "a b", 8), (2, None, 9), (2, "", 9), (3, "word " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in tc.token_counts(df, PATH).collect())
    one = ours(tc.Counter(*tc.vocabulary(PATH)), "a b")
    assert got[:4] == [(0, one), (1, one), (2, 0), (2, 0)] and got[4][1] > 30_000
    assert tc.token_counts(df.limit(0), PATH).collect() == []
