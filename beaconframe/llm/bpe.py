"""BPE encoding and decoding through a distinct-word table, in part.

The merges of a word-level BPE never cross a word, so each distinct word needs
one encoding. Spark splits all texts into words, counts the distinct ones in
one shuffle and encodes each frequent one once; that table has at most
1 / FREQUENT rows at any input size and is broadcast to the tasks. Words below
that frequency, most of which occur in one place only, are encoded in the task
that meets them, and again after TASK_WORDS of them. Within a task ids are looked
up in these tables in the order of the words, and decoding looks pieces up in
the vocabulary's list: neither is a join of Spark's.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.llm._text import bounded_batches, give_back, slices
from beaconframe.operators.state import materialize

#: A word is in the shared table if it makes up this share of all words, so the table has 250,000 rows at most.
FREQUENT = 4e-6
#: Letters beyond these long settled ranges may be classed differently by another edition of Unicode; the library itself splits texts that hold them.
SETTLED = regex.compile(r"[\x00-\u024F\u0391-\u03A1\u03A3-\u03CE\u0410-\u044F\u2010-\u2027\u2030-\u205E\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5]*")
#: Distinct words that a task keeps beside the table before it starts anew.
TASK_WORDS = 200_000


@cache
def _told(path: str) -> dict:
    """What the tokenizer's file states."""
    import json

    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _made(told: dict):
    """A tokenizer of such a statement, on one thread: a task has one core."""
    import json

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(json.dumps(told | {"truncation": None, "padding": None}))


@cache
def _tokenizer(path: str):
    return _made(_told(path))


@cache
def _splitter(path: str):
    """The file's normaliser and splitter without its vocabulary."""
    return _made(_told(path) | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})


@cache
def _merger(path: str):
    """The file's merges for words that are normalised and split already: each word is one piece."""
    told = _told(path)
    rest = [x for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] != "Split"]
    return _made(told | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": rest}})


@cache
def _rules(path: str):
    """(special texts' pattern and ids, word pattern) as the tokenizer's file states them."""
    told = _told(path)
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    pattern = next(x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    cut = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
    # \s is the White_Space property there; this library's has a few control characters more.
    return cut, special, regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))


@cache
def _pieces(path: str) -> list[bytes]:
    """The table id -> piece."""
    tokenizer = _merger(path)
    return [(tokenizer.id_to_token(i) or "").encode() for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def _lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is a sigma."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def words_in(text: str, path: str) -> list[str]:
    """The words that the tokenizer's normaliser and splitter make of a text; special tokens as they stand."""
    cut, special, word = _rules(path)

    def plain(t: str) -> list[str]:
        if t.isascii():
            return word.findall(t.lower())
        if SETTLED.fullmatch(t):
            return word.findall(_lower(unicodedata.normalize("NFC", t)))
        tokenizer = _splitter(path)
        t = tokenizer.normalizer.normalize_str(t)
        return [t[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(t)]

    if cut is None or "<|" not in text:
        return plain(text)
    out, at = [], 0
    for m in cut.finditer(text):
        out += plain(text[at : m.start()])
        out.append(m[0])
        at = m.end()
    return out + plain(text[at:])


def encode_words(words: list[str], path: str) -> list[bytes]:
    """Ids of each word as little-endian 32-bit integers."""
    _, special, _ = _rules(path)
    encoded = _merger(path).encode_batch_fast([" " if w in special else w for w in words], add_special_tokens=False)
    return [np.array([special[w]] if w in special else e.ids, "<u4").tobytes() for w, e in zip(words, encoded, strict=True)]


def _count_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for text in part.column("text").to_pylist():
                for word in words_in(text or "", path):
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > 2 * TASK_WORDS:
                yield out()
                counts.clear()
        yield out()

    return run


def _encode_table(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(encode_words(words, path), pa.binary())], ["word", "ids"])

    return run


def word_table(docs: DataFrame, path: str, frequent: float = FREQUENT) -> DataFrame:
    """(word, ids): each word that makes up at least `frequent` of all words, encoded once."""
    counts = materialize(docs.mapInArrow(_count_words(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(2.0, total * frequent)).select("word").mapInArrow(_encode_table(path), "word string, ids binary")


class Encoder:
    """Looks words' ids up: in the shared table first, then in the task's own table of other words."""

    def __init__(self, path: str, shared: dict[str, bytes]):
        self.path, self.table, self.own = path, dict(shared), 0
        self.shared = shared

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [words_in(t or "", self.path) for t in texts]
        new = list(set().union(*split).difference(self.table))
        if self.own + len(new) > TASK_WORDS:
            self.table, self.own = dict(self.shared), 0
            new = list(set().union(*split).difference(self.table))
        self.table.update(zip(new, encode_words(new, self.path), strict=True))
        self.own += len(new)
        return [b"".join(map(self.table.__getitem__, words)) for words in split]


def decode(ids: bytes, path: str) -> bytes:
    """The pieces of the ids, with a space between, as the tokenizer without a decoder has them."""
    return b" ".join(map(_pieces(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encode(path: str, shared, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, shared.value)
        for part in slices(batches, most=1 << 20):
            yield finish(part, encoder(part.column("text").to_pylist()))
        del encoder
        give_back()

    return run


def _shared_table(docs: DataFrame, path: str, frequent: float):
    """The frequent words' table, broadcast; `frequent` bounds its rows by 1 / frequent."""
    bounded_batches(docs.sparkSession)
    rows = word_table(docs, path, frequent).toLocalIterator(prefetchPartitions=True)
    return docs.sparkSession.sparkContext.broadcast({r["word"]: bytes(r["ids"]) for r in rows})


def encode_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", frequent: float = FREQUENT) -> DataFrame:
    """(doc_id, ids array<int>) for each row.

    A null text counts as empty, an empty one has no ids; a null doc_id is
    kept; repeated rows are encoded each; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def finish(part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "ids"])

    return docs.mapInArrow(_encode(path, _shared_table(docs, path, frequent), finish), "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of (doc_id, ids array<int>), ids that are not in the vocabulary left out; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            texts = [" ".join(pieces[i].decode() for i in row or () if i is not None and 0 <= i < len(pieces)) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def bpe_digests(df: DataFrame, path: str, frequent: float = FREQUENT, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, for each row of `documents`; `with_ids` adds the ids, an array<int>.

    Nulls, empty and repeated rows are treated as by `encode_documents`.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finish(part: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        size = [len(x) // 4 for x in ids]
        lists = []
        if with_ids:
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(size, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decode(x, path)).hexdigest() for x in ids], pa.string()),
                *lists,
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] * with_ids)],
        )

    return docs.mapInArrow(_encode(path, _shared_table(docs, path, frequent), finish), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
