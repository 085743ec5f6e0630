"""Token counts without tokens: Viterbi over a unigram vocabulary that carries score and piece count only.

An Aho-Corasick automaton enumerates the vocabulary's pieces that end at each
letter, longest first. Each position keeps the best score and the number of
pieces on the way to it; nothing is traced back. Ties go to the earlier start,
i.e. the longer last piece, as in the tokenizer: a later candidate must be
better to win. A letter without a piece of its own costs the least score of
the vocabulary minus 10 and counts one piece for each of its bytes, or one for
a run of such letters if the vocabulary has no byte pieces.

Texts are cut before each space, as the tokenizer cuts them, so each distinct
stretch is counted once for each batch and task that holds it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.llm._text import encoded, per_row_sums, slices

SPACE = "▁"
#: What an unknown letter costs below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Distinct stretches whose counts a task remembers before it starts anew.
TASK_WORDS = 400_000


@cache
def vocabulary(path: str) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """Pieces and scores of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids)


class Counter:
    """Counts pieces of stretches of text; equal to a unigram tokenizer of the same pieces, scores and byte fallback."""

    def __init__(self, pieces: Iterable[str], scores: Iterable[float]):
        import ahocorasick

        pieces, scores = list(pieces), list(scores)
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(pieces, scores, strict=True):
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.letters = {x for x in pieces if len(x) == 1}
        known = set(pieces)
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        n = len(text)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, piece in self.automaton.iter(text):
            ends.setdefault(end, []).append(piece)
        lost = [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            for length, score in ends.get(end - 1, ()):
                score += best[end - length]
                if top is None or score > top:
                    top, count[end], lost[end] = score, count[end - length] + 1, False
            if (letter := text[end - 1]) not in self.letters:
                score = self.unknown + best[end - 1]
                if top is None or score > top:
                    more = len(letter.encode()) if self.bytes else 0 if lost[end - 1] else 1
                    top, count[end], lost[end] = score, count[end - 1] + more, True
            best[end] = top
        return count[n]

    def counts(self, values: list[str]) -> np.ndarray:
        if len(self.known) + len(values) > TASK_WORDS:
            self.known.clear()
        known, out = self.known, np.empty(len(values), np.int64)
        for i, value in enumerate(values):
            found = known.get(value)
            if found is None:
                found = known[value] = self.count(value)
            out[i] = found
        return out


def stretches(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The texts cut before each space, spaces written as the vocabulary has them, a first one put before a text without: (number for each row, all)."""
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
    full = pc.greater(pc.binary_length(texts), 0)
    lists = pc.split_pattern(texts, " ")
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.flatten()
    # What stands before the first space is a stretch of its own unless the text begins with that space.
    first = np.zeros(len(values), bool)
    at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    first[at] = True
    leading = first & (pc.binary_length(values).to_numpy(zero_copy_only=False) == 0)
    drop = leading | ~np.repeat(full.to_numpy(zero_copy_only=False), counts)
    rows = np.repeat(np.arange(len(counts)), counts)
    values = values.filter(pa.array(~drop))
    return np.bincount(rows[~drop], minlength=len(counts)).astype(np.int64), pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), values, pa.scalar("", pa.large_string()))


def token_counts(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) for each row: pieces of the best segmentation of the whole text.

    A null or empty text has none; a null doc_id is kept; repeated rows are
    counted each; other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*vocabulary(path))
        for part in slices(batches):
            n, values = stretches(part.column("text"))
            index, distinct = encoded(values)
            each = counter.counts(distinct.to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(per_row_sums(each[index], n))], ["doc_id", "n_tokens"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
