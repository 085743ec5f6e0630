"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

Words are compared by the gap-weighted kernel of three-letter subsequences, so
an insult is near its own gapped and inserted-character forms; letters written
one by one are read as a word too. Landmarks are words of a bounded sample of
labelled rows. A text is the bag of its words under the max kernel with each
landmark; Nyström whitening makes these values features, a linear SVM with
squared hinge loss is trained on them and a logistic curve turns its margin into a score.
The floor below which a word has no say is chosen by cross-validation within the
rows that are learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconframe.llm._text import bounded_batches, encoded, give_back, mix, slices, words_of
from beaconframe.operators.state import Scratch

#: Letters from the first to the last of a subsequence, gaps included, and the weight of each gap.
SPAN, DECAY = 8, 0.6
#: Longer words are read in overlapping pieces of this many letters.
PIECE = 24
#: A word below a floor of similarity to every landmark of toxic rows has no say; the floors to choose from, and the parts of the cross-validation.
FLOORS, FOLDS = (0.3, 0.4, 0.5), 5
#: Labelled rows to learn from at most, and landmark words of toxic and of clean rows.
SAMPLE, TOXIC_WORDS, CLEAN_WORDS = 20_000, 48, 16
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
#: Words that a task remembers.
TASK_WORDS = 150_000
#: Words compared with the landmarks at a time; each has some two hundred subsequences.
PARTS = 3_000
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~¡¿«»"
_NO_EDGE = str.maketrans("", "", _EDGE)
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, three letters as one integer, weight) of each subsequence within SPAN; words begin with a mark of their start."""
    lens = np.array([len(w) + 1 for w in words], np.int64)
    letters = np.frombuffer("".join("\x02" + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(letters))
    row, key, weight = [], [], []
    for a, b in _STEPS:
        at = np.flatnonzero(left > a + b)
        row.append(owner[at])
        key.append((letters[at] << 42) | (letters[at + a] << 21) | letters[at + a + b])
        weight.append(np.full(len(at), DECAY ** (a + b - 2)))
    return np.concatenate(row), np.concatenate(key), np.concatenate(weight)


def _summed(row: np.ndarray, key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(row):
        return row, key, weight
    order = np.lexsort((key, row))
    row, key, weight = row[order], key[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))
    return row[new], key[new], np.add.reduceat(weight, new)


def _norms(words: list[str]) -> np.ndarray:
    row, _, weight = _summed(*subsequences(words))
    return np.sqrt(np.bincount(row, weight**2, len(words)))


def _short(key: np.ndarray) -> np.ndarray:
    return (key ^ (key >> 15) ^ (key >> 29)) & 0xFFFF


@dataclass
class Landmarks:
    words: list[str]
    toxic: int  #: the first so many are words of toxic rows
    floor: float = FLOORS[0]
    keys: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        row, key, weight = _summed(*subsequences(self.words))
        norm = np.sqrt(np.bincount(row, weight**2, len(self.words)))
        self.keys = np.unique(key)
        self.table = np.zeros((len(self.keys), len(self.words)))
        self.table[np.searchsorted(self.keys, key), row] = weight / norm[row]
        self.best = self.table[:, : self.toxic].max(1, initial=0)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[_short(self.keys[self.best > 0])] = True
        n = np.arange(PIECE + 2)
        self.least = np.sqrt(sum(np.maximum(n - a - b, 0) * DECAY ** (2 * (a + b - 2)) for a, b in _STEPS))

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words with a similarity of `floor` or more, squared similarities of these to each landmark)."""
        none = np.zeros(0, np.int64), np.zeros((0, len(self.words)))
        if not words or not len(self.keys):
            return none
        row, key, weight = subsequences(words)
        hit = np.flatnonzero(self.maybe[_short(key)])
        row, key, weight = row[hit], key[hit], weight[hit]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        row, at, weight = row[hit], at[hit], weight[hit]
        low = self.least[np.array([len(w) + 1 for w in words])]
        high = np.bincount(row, weight * self.best[at], len(words))
        some = (low > 0) & (high >= self.floor * low)
        use = some[row]
        row, at, weight = row[use], at[use], weight[use]
        if not len(row):
            return none
        order = np.argsort(row, kind="stable")
        row, at, weight = row[order], at[order], weight[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        k = np.add.reduceat(self.table[at] * weight[:, None], first, axis=0)
        found = row[first]
        k /= _norms([words[i] for i in found])[:, None]
        good = k[:, : self.toxic].max(1, initial=0) >= self.floor
        return found[good], k[good] ** 2


def pieces_of(word: str) -> list[str]:
    word = word.strip(_EDGE).lower()
    if not word.isalnum():  # marks within a word do not hide it
        word = word.translate(_NO_EDGE)
    if len(word) <= PIECE:
        return [word] if len(word) > 2 else []
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def _spelled(counts: np.ndarray, index: np.ndarray, values: list[str]) -> Iterator[tuple[int, str]]:
    """(row, word) of words written letter by letter: three single letters or more in a row."""
    single = np.array([len(v) == 1 and v.isalpha() for v in values], bool)[index] if len(values) else np.zeros(0, bool)
    if not single.any():
        return
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(single)
    runs = np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(rows[at]) != 0)) + 1)
    for run in runs:
        if len(run) >= 3:
            for piece in pieces_of("".join(values[i] for i in index[run])):
                yield int(rows[run[0]]), piece


def _bag(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, word number) without repeats, and the words as they stand plus the spelled ones."""
    counts, words = words_of(texts)
    index, values = encoded(words)
    values = values.to_pylist()
    rows = np.repeat(np.arange(len(counts)), counts)
    spelled = list(_spelled(counts, index, values))
    n = len(values)
    values += [w for _, w in spelled]
    rows = np.concatenate([rows, np.array([r for r, _ in spelled], np.int64)])
    index = np.concatenate([index, np.arange(n, n + len(spelled))])
    both = np.unique(rows * max(1, len(values)) + index)
    return both // max(1, len(values)), both % max(1, len(values)), values


class Features:
    """Max kernel of each text's words with each landmark; remembers the words of its task."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks, self.known, self.rows = landmarks, {}, [np.zeros((1, len(landmarks.words)))]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return self.pooled(texts, [self.landmarks.floor])[0]

    def pooled(self, texts: pa.Array, floors: list[float]) -> list[np.ndarray]:
        """The features for each of several floors, none below the landmarks' own."""
        row, index, values = _bag(texts)
        if len(self.known) > TASK_WORDS:
            self.known, self.rows = {}, self.rows[:1]
        new = [v for v in values if v not in self.known]
        parts, owner = [], []
        for v in new:
            self.known[v] = 0
            for p in pieces_of(v):
                parts.append(p)
                owner.append(v)
        n = sum(map(len, self.rows))
        for i in range(0, len(parts), PARTS):
            found, k = self.landmarks.near(parts[i : i + PARTS])
            for j, vector in zip(found, k, strict=True):
                v = owner[i + int(j)]
                if self.known[v]:
                    vector = np.maximum(vector, self.vector(self.known[v]))
                self.rows.append(vector[None])
                self.known[v] = n
                n += 1
        self.rows = [np.concatenate(self.rows)]
        slot = np.array([self.known[v] for v in values], np.int64)[index] if len(values) else index
        best = self.rows[0][:, : self.landmarks.toxic].max(1, initial=0)[slot]
        return [self._pool(len(texts), row, slot, np.flatnonzero((slot > 0) & (best >= floor**2))) for floor in floors]

    def _pool(self, n: int, row: np.ndarray, slot: np.ndarray, hit: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(self.landmarks.words)))
        if len(hit):
            first = np.flatnonzero(np.concatenate([[True], row[hit][1:] != row[hit][:-1]]))
            for i in range(0, len(first), 256):
                a, b = first[i], first[i + 256] if i + 256 < len(first) else len(hit)
                out[row[hit][first[i : i + 256]]] = np.maximum.reduceat(self.rows[0][slot[hit[a:b]]], first[i : i + 256] - a, axis=0)
        return out

    def vector(self, n: int) -> np.ndarray:
        for block in self.rows:
            if n < len(block):
                return block[n]
            n -= len(block)
        raise IndexError


@dataclass
class ToxicityModel:
    landmarks: Landmarks
    whiten: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, k: np.ndarray) -> np.ndarray:
        margin = k @ self.whiten @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Primal Newton steps of a linear SVM with squared hinge loss; the bias is the last weight."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) / cost
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        on = y * (x @ w) < 1
        new = np.linalg.solve(ridge + x[on].T @ x[on], x[on].T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * (w + new)
    return w


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x, w, t = np.stack([f, np.ones_like(f)], 1), np.zeros(2), (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def _loss(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """Cross-validated log loss of the machine with its curve; parts without both classes to learn from do not count."""
    total = 0.0
    for i in range(FOLDS):
        rest, own = fold != i, fold == i
        if own.any() and (y[rest] > 0).any() and (y[rest] < 0).any():
            w = _svm(x[rest], y[rest])
            slope, offset = _logistic(x[rest] @ w[:-1] + w[-1], y[rest])
            total += np.logaddexp(0, -y[own] * (slope * (x[own] @ w[:-1] + w[-1]) + offset)).sum()
    return total


def fit_toxicity(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn from the rows of `df` (doc_id, text) that `labels` (doc_id, toxic) marks.

    At most `sample` labelled rows are used, those of the smallest hash of
    doc_id. Null labels, ids and texts are left out. Without a row of each
    class the model scores every text with the share of toxic rows (0 if no
    row is labelled).
    """
    with Scratch(df.sparkSession) as table:
        return _fit(df, labels, sample, table)


def _fit(df: DataFrame, labels: DataFrame, sample: int, table: Scratch) -> ToxicityModel:
    spark = df.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    known = marks.join(there.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = table(there.join(F.broadcast(known), "doc_id"), "labelled")  # the texts of `sample` rows at most, read twice

    def words(batches):
        for part in slices(batches, most=1 << 20):
            row, index, values = _bag(part.column("text"))
            cut = [pieces_of(v) for v in values]
            toxic = part.column("toxic").to_numpy()[row]
            out: dict[str, list[int]] = {}
            for hot in (0, 1):
                for i, n in zip(*np.unique(index[toxic == hot], return_counts=True), strict=True):
                    for p in cut[i]:
                        out.setdefault(p, [0, 0])[hot] += int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([c for c, _ in out.values()], pa.int64()), pa.array([t for _, t in out.values()], pa.int64())], ["word", "clean", "toxic"])

    total = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = total[1] / total[0] if total[0] else 0.0
    tally = picked.mapInArrow(words, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    tally = table(tally.where("clean + toxic > 2"), "words")
    expected = (F.col("clean") + F.col("toxic")) * rate
    ranked = tally.withColumn("z", (F.col("toxic") - expected) / F.sqrt(expected + 1))
    hot = [r["word"] for r in ranked.where("z > 2").orderBy(F.desc("z"), "word").limit(TOXIC_WORDS * 16).collect()]
    cold = [r["word"] for r in ranked.where("z < 0").orderBy(F.desc("clean"), "word").limit(CLEAN_WORDS).collect()]
    chosen: list[str] = []
    for word in hot:
        if len(chosen) == TOXIC_WORDS:
            break
        if not chosen or np.sqrt(Landmarks(chosen, len(chosen)).near([word])[1].max(initial=0)) < 0.85:
            chosen.append(word)
    landmarks = Landmarks(chosen + cold, len(chosen))
    m = len(landmarks.words)
    constant = ToxicityModel(landmarks, np.eye(m), np.zeros(m + 1), 0.0, float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
    if not chosen or not 0 < rate < 1:
        return constant
    shared = spark.sparkContext.broadcast(landmarks)

    def vectors(batches):
        features = Features(shared.value)
        for part in slices(batches, most=1 << 20):
            k = np.concatenate(features.pooled(part.column("text"), list(FLOORS)), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(list(k), pa.list_(pa.float64()))], ["doc_id", "toxic", "k"])

    rows = picked.mapInArrow(vectors, "doc_id long, toxic int, k array<double>").toArrow()  # numbers of `sample` rows
    ids = rows.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    every = pc.list_flatten(rows.column("k")).to_numpy().reshape(len(ids), len(FLOORS), m)[order]
    y, ids = np.where(rows.column("toxic").to_numpy() > 0, 1.0, -1.0)[order], ids[order]
    del rows
    kll = np.zeros((m, m))
    kll[:] = (landmarks.table.T @ landmarks.table) ** 2
    value, vector = np.linalg.eigh((kll + kll.T) / 2 + 1e-6 * np.eye(m))
    whiten = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    fold = (mix(ids.astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    losses = [_loss(every[:, i] @ whiten, y, fold) for i in range(len(FLOORS))]
    landmarks.floor = FLOORS[int(np.argmin(losses))]
    x = every[:, int(np.argmin(losses))] @ whiten
    w = _svm(x, y)
    curve = _logistic(x @ w[:-1] + w[-1], y)
    del every, x
    give_back()
    return ToxicityModel(landmarks, whiten, w, *curve)


def _scored(model, finish):
    def run(batches):
        features = Features(model.value.landmarks)
        for part in slices(batches, most=1 << 20):
            yield finish(part, model.value.scores(features(part.column("text"))))
        give_back()

    return run


def score_toxicity(df: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each row of `df`.

    Whole texts are read. A null text counts as empty and gets the score of a
    text without any landmark; a null doc_id is kept; repeated rows are scored
    each; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def finish(part: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scored(shared, finish), "doc_id long, score double, predicted int")


def keep_civil(df: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df`, with all columns, whose `text` scores below the threshold."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def finish(part: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(score < threshold))

    return df.mapInArrow(_scored(shared, finish), df.schema)


def trainable(df: DataFrame) -> DataFrame:
    """Rows that a model may learn from: crc32 of doc_id as text, modulo 4, is not 2."""
    return df.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
