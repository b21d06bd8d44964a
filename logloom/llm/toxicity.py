"""Toxicity by a string-kernel SVM on sentences, with Nystroem landmarks.

The kernel of two words is the inner product of their gapped three-letter subsequences: three
letters in order within five places, each letter skipped costing a factor GAP and other signs
skipped freely. "i-d-i-o-t" and "idxiot" share subsequences with "idiot", and so do its
compounds; runs of single letters ("s t u p i d") count as one word as well. A sentence meets each landmark in the word that is
nearest to it; Nystroem's map of those values goes into a linear SVM with squared hinge loss.
A document's score is that of its worst sentence, through a sigmoid fitted to documents.

A value is the share of the landmark's own subsequences that the word has, to the power POWER
(a polynomial kernel over them). Landmarks are words of the labelled documents: those most
particular to toxic ones by likelihood ratio, a few of each family, and the most usual ones of
the clean. Training has two rounds: of each toxic document the sentence nearest to the toxic
landmarks (then: the worst by the first model) is positive, as it stands and with a letter put
into each word; of each clean document that sentence and one at random are negative.

The classifier is fitted on at most SAMPLE labelled documents of each class, taken in order of
the hash of their doc_id; all texts are scored whole, by Spark tasks that keep the values of
words they have seen. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have one empty sentence and a score. Repeated rows are scored alike; of
labels that differ for one doc_id the toxic one holds. Without labels of both classes every
score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logloom.operators.stages import staged

SAMPLE, CANDIDATES, TOXIC_LANDMARKS, CLEAN_LANDMARKS, FAMILY = 4_000, 1_500, 64, 16, 3
EVIDENCE, POWER = 15.0, 2
GAP, OFFSETS = 0.75, ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
SLOTS, WORDS_KEPT = 1 << 22, 250_000
THRESHOLD = 0.7
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().replace("\n", " . ").split()


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, slot, weight) of every gapped three-letter subsequence."""
    words = [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in words]
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = []
    for second, third in OFFSETS:
        n = len(codes) - third
        if n <= 0:
            continue
        key = codes[:n] * _FACTORS[0] + codes[second:second + n] * _FACTORS[1] + codes[third:] * _FACTORS[2]
        key ^= key >> np.uint64(32)
        slot = ((key * _FACTORS[0]) >> np.uint64(42)).astype(np.int64)
        own = np.flatnonzero(owner[:n] == owner[third:])
        out.append((owner[own], slot[own], np.full(len(own), GAP ** (third - 2))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


class Landmarks:
    """Kernel values of words with the landmarks, by a table from subsequence to landmark weights."""

    def __init__(self, words: list[str]):
        self.words = words
        owner, slot, weight = subsequences(words)
        used, row = np.unique(slot, return_inverse=True)
        self.weights = np.zeros((len(used) + 1, len(words)), np.float32)
        np.add.at(self.weights, (row + 1, owner), weight)
        self.norms = np.sqrt(np.maximum((self.weights ** 2).sum(axis=0), 1e-9)).astype(np.float32)
        self.weights /= self.norms
        self.rows = np.zeros(SLOTS, np.int32)
        self.rows[used] = np.arange(1, len(used) + 1)

    def values(self, words: list[str]) -> np.ndarray:
        owner, slot, weight = subsequences(words)
        row = self.rows[slot]
        met = np.flatnonzero(row)
        out = np.zeros((len(words), len(self.words)), np.float32)
        if len(met):
            order = np.argsort(owner[met], kind="stable")
            met = met[order]
            first = np.flatnonzero(np.diff(owner[met], prepend=-1))
            for at in range(0, len(first), 20_000):
                begin, end = first[at], first[at + 20_000] if at + 20_000 < len(first) else len(met)
                part = met[begin:end]
                starts = first[at:at + 20_000] - begin
                out[owner[part[starts]]] = np.add.reduceat(self.weights[row[part]] * weight[part, None].astype(np.float32), starts)
        return (out / self.norms) ** POWER


class _Seen(dict):
    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


class Sentences:
    """Landmark values of the sentences of one text after another; remembers words."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self._forget()

    def _forget(self) -> None:
        self.seen, self.known = _Seen(), 0
        self.values = np.zeros((1024, len(self.landmarks.words)), np.float32)
        self.ends, self.single = np.zeros(1024, bool), np.zeros(1024, bool)

    def _learn(self, words: list[str]) -> None:
        total = self.known + len(words)
        while total > len(self.values):
            self.values, self.ends, self.single = (np.concatenate([x, np.zeros_like(x)]) for x in (self.values, self.ends, self.single))
        self.values[self.known:total] = self.landmarks.values(words)
        self.ends[self.known:total] = [w[-1:] in ".!?" for w in words]
        self.single[self.known:total] = [len(w.strip(".,;:!?-_*'\"")) == 1 for w in words]
        self.known = total

    def _index(self, words: list[str]) -> np.ndarray:
        index = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        if len(self.seen) > self.known:
            fresh = {}
            for w, i in zip(words, index.tolist()):
                if i >= self.known:
                    fresh[i] = w
            self._learn([fresh[i] for i in sorted(fresh)])
        return index

    def of(self, text: str | None) -> np.ndarray:
        """One row per sentence."""
        if self.known > WORDS_KEPT:
            self._forget()
        words = tokens(text)
        if not words:
            return np.zeros((1, len(self.landmarks.words)), np.float32)
        index = self._index(words)
        starts = np.flatnonzero(np.concatenate([[True], self.ends[index[:-1]]]))
        met = np.maximum.reduceat(self.values[index], starts, axis=0)
        single = self.single[index]
        if (single[:-2] & single[1:-1] & single[2:]).any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= 3:
                    spelled = self._index(["".join(w.strip(".,;:!?-_*'\"") for w in words[a:b])])
                    at = np.searchsorted(starts, a, side="right") - 1
                    met[at] = np.maximum(met[at], self.values[spelled[0]])
        return met


@dataclass
class Model:
    """Linear in the landmark values; `slope` and `shift` of the sigmoid over documents."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def sentence_scores(self, met: np.ndarray) -> np.ndarray:
        return met @ self.weights + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


_BY_WORKER: dict[str, Sentences] = {}


def _sentences(words: list[str]) -> Sentences:
    """One per worker and set of landmarks."""
    key = "\n".join(words)
    if key not in _BY_WORKER:
        _BY_WORKER.clear()
        _BY_WORKER[key] = Sentences(Landmarks(words))
    return _BY_WORKER[key]


def sample(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label): at most `size` labelled documents of each class, by hash of doc_id."""
    told = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).where(usable)
    order = F.xxhash64("doc_id", F.lit("sample"))
    few = told.where("label = 1").orderBy(order).limit(size).union(told.where("label = 0").orderBy(order).limit(size))
    few = staged(few.withColumnRenamed("doc_id", "labelled"), "toxic-sample-ids")
    met = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("labelled"))  # 2 * size rows at most
    return staged(met.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxic-sample")


def choose_landmarks(sampled: DataFrame, counts: dict[int, int]) -> tuple[list[str], int]:
    """Landmark words, and how many of them (the first) are toxic ones."""
    words = sampled.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
    words = words.select("label", F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word")).where("char_length(word) BETWEEN 3 AND 40")
    held = words.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    n1, n0 = counts[1], counts[0]
    both = F.col("toxic") + F.col("clean")

    def part(seen: Column, of: int) -> Column:
        lacks, none = of - seen, n1 + n0 - both
        return (F.when(seen > 0, seen * F.log(seen * (n1 + n0) / (both * of))).otherwise(0.0)
                + F.when(lacks > 0, lacks * F.log(lacks * (n1 + n0) / (none * of))).otherwise(0.0))

    told = held.withColumn("gain", 2 * (part(F.col("toxic"), n1) + part(F.col("clean"), n0)))
    told = told.where((F.col("toxic") * n0 > F.col("clean") * n1 * 2) & (F.col("gain") > EVIDENCE))
    ranked = [r[0] for r in told.orderBy(F.desc("gain"), "word").limit(CANDIDATES).select("word").collect()]
    usual = [r[0] for r in held.orderBy(F.desc("clean"), "word").limit(CLEAN_LANDMARKS).select("word").collect()]
    chosen: list[str] = []
    if ranked:
        index = Landmarks(ranked)
        near = index.values(ranked)
        near = np.maximum(near, near.T) > 0.5**POWER
        picked: list[int] = []
        for i in range(len(ranked)):
            if index.norms[i] > 0.1 and near[i, picked].sum() < FAMILY and len(picked) < TOXIC_LANDMARKS:
                picked.append(i)
        chosen = [ranked[i] for i in picked]
    return chosen + [w for w in usual if w not in chosen], len(chosen)


def _with_letter(word: str, seed: int) -> str:
    """The word with one letter put between its second and its last."""
    if len(word) < 4:
        return word
    at = 2 + (seed + len(word)) % (len(word) - 3)
    return word[:at] + "abcdefghijklmnopqrstuvwxyz"[(seed * 7 + len(word)) % 26] + word[at:]


def _examples(sampled: DataFrame, words: list[str], weights: np.ndarray, bias: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per sampled document its label, its sentence of the highest score, and another: of toxic
    documents the same with a letter put into each word, else one at random."""
    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, label, text in zip(batch["doc_id"], batch["label"], batch["text"]):
                sentences = _sentences(words)
                met = sentences.of(text)
                worst = met[int(np.argmax(met @ weights + bias))]
                if label:
                    broken = sentences.of(" ".join(_with_letter(w, int(doc_id)) for w in tokens(text)))
                    other = broken[int(np.argmax(broken @ weights))]
                else:
                    other = met[int(doc_id) % len(met)]
                out.append((label, worst.tobytes(), other.tobytes()))
            yield pd.DataFrame(out, columns=["label", "worst", "other"])

    rows = sampled.mapInPandas(pick, "label int, worst binary, other binary").collect()
    return [(r[0], np.frombuffer(r[1], np.float32), np.frombuffer(r[2], np.float32)) for r in rows]


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared hinge loss, classes weighted alike, by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(a.T @ (a * share[inside, None]) + ridge, a.T @ (share[inside] * y[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _sigmoid(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift by logistic regression with smoothed targets."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    goal = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([margins, np.ones_like(margins)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - goal))
        w = w - np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE) -> Model | None:
    """The model from the labels for which `usable` (over doc_id) holds; None unless both classes occur."""
    sampled = sample(docs, labels, usable, size)
    counts = {0: 0, 1: 0} | {r[0]: r[1] for r in sampled.groupBy("label").count().collect()}
    if not all(counts.values()):
        return None
    words, toxic = choose_landmarks(sampled, counts)
    if not words:
        return None
    landmarks = Landmarks(words)
    gram = landmarks.values(words).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    weights, bias = np.where(np.arange(len(words)) < toxic, 1.0, 0.0), 0.0
    for _ in range(2):
        seen = _examples(sampled, words, weights, bias)
        worst, other = np.stack([e[1] for e in seen]), np.stack([e[2] for e in seen])
        label = np.array([e[0] for e in seen])
        sign = np.where(label == 1, 1.0, -1.0)
        theta, bias = _svm(np.vstack([worst, other]).astype(np.float64) @ root, np.concatenate([sign, sign]))
        weights = root @ theta
    seen = _examples(sampled, words, weights, bias)
    margins = np.stack([e[1] for e in seen]).astype(np.float64) @ weights + bias
    slope, shift = _sigmoid(margins, np.array([e[0] for e in seen]) == 1)
    return Model(words, weights, bias, slope, shift)


def toxicity(model: Model | None, text: str = "text") -> Column:
    """The score of a text column, 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        sentences = _sentences(model.landmarks)
        return pd.Series([model.probability(float(model.sentence_scores(sentences.of(t)).max())) for t in texts], dtype=float)

    return score(F.col(text))


def keep_clean(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score `threshold` or more."""
    return docs.where(toxicity(fit(docs, labels, usable)) < threshold)
