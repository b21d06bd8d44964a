"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words (runs of letters and digits, or of other signs) fall into BUCKETS hashed buckets. Each
bucket has a sparse random index vector; its word vector is the sum, over every occurrence in
every document, of the index vectors of its neighbours (the left ones turned by one place).
A task sums its own matrix and emits it in blocks, which are added up in two streaming steps
that hold one block of each kind at a time, so the size of the result is fixed whatever the
input. A document pools its words' vectors: the mean word vector, the mean index vector, the
lengths of both (few different words make long means), the share of words that repeat the one
before, and its size.

The network (tanh layer, then a logistic unit) is trained in numpy on at most SAMPLE labelled
documents of each class, in order of the hash of their doc_id, weighted back to the classes'
shares; a temperature fitted on a fifth of them calibrates its probabilities. All texts are
scored whole. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts pool to zeros and have a score. Of labels that differ for one doc_id the
lower one holds. Without labels of both classes every score is 0.5. An empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from logloom.operators.stages import staged

BUCKETS, WIDTH, NONZERO = 1 << 14, 64, 4
BLOCKS, SALTS = 16, 16
SAMPLE, HIDDEN, EPOCHS = 4_000, 32, 60
WORDS_KEPT, STEP = 500_000, 400_000
THRESHOLD = 0.7
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries, per bucket."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1, 1], (BUCKETS, NONZERO))


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = crc32(word) & (BUCKETS - 1)
        return self[word]


def _buckets_of(known: _Buckets, text: str | None) -> np.ndarray:
    words = _TOKEN.findall((text or "").lower().encode())
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, part -> this task's sums of neighbours' index vectors, in blocks of buckets."""
    places, signs = index_vectors()
    known, sums, part, any_text = _Buckets(), np.zeros(BUCKETS * WIDTH, np.int64), 0, False

    def add(texts: list[np.ndarray]) -> None:
        ids = np.concatenate(texts)
        follows = np.ones(len(ids), bool)
        follows[np.cumsum([len(t) for t in texts[:-1]], dtype=np.int64)] = False
        at = np.flatnonzero(follows[1:])
        left, right = ids[at], ids[at + 1]
        for k in range(NONZERO):
            for of, near, turn in ((left, right, 0), (right, left, 1)):
                cells = of * WIDTH + (places[near, k] + turn) % WIDTH
                sums[:] += np.bincount(cells, weights=signs[near, k], minlength=len(sums)).astype(np.int64)

    waiting, size = [], 0
    for batch in batches:
        any_text = True
        part = batch.column(1)[0].as_py() if batch.num_rows else part
        for text in batch.column(0).to_pylist():
            ids = _buckets_of(known, text)
            if len(ids):
                waiting.append(ids)
                size += len(ids)
            if size >= STEP:
                add(waiting)
                waiting, size = [], 0
    if waiting:
        add(waiting)
    if any_text:
        yield from _as_blocks({b: sums.reshape(BLOCKS, -1)[b] for b in range(BLOCKS)}, part)


def _as_blocks(blocks: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for block, values in blocks.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([pack.compress(values.tobytes())], pa.binary())})


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks that meet here, one array per kind of block."""
    blocks: dict[int, np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    part = 0
    for batch in batches:
        for block, part, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            values = np.frombuffer(unpack.decompress(data), np.int64)
            blocks[block] = blocks[block] + values if block in blocks else values
    yield from _as_blocks(blocks, part)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x WIDTH unit vectors from all documents; zeros for buckets that never occur beside another."""
    kind = "block int, part int, sums binary"
    sums = docs.select("text", F.spark_partition_id().alias("part")).mapInArrow(_context_sums, kind)
    halfway = sums.repartition(BLOCKS * SALTS, "block", F.pmod("part", F.lit(SALTS))).mapInArrow(_added, kind)
    rows = halfway.repartition(BLOCKS, "block").mapInArrow(_added, kind).collect()
    whole = np.zeros((BLOCKS, BUCKETS // BLOCKS * WIDTH), np.float64)
    for r in rows:
        whole[r["block"]] += np.frombuffer(zstandard.ZstdDecompressor().decompress(r["sums"]), np.int64)
    whole = whole.reshape(BUCKETS, WIDTH)
    return (whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Pool:
    """Document features from word and index vectors."""

    def __init__(self, vectors: np.ndarray):
        places, signs = index_vectors()
        own = np.zeros((BUCKETS, WIDTH), np.float32)
        np.put_along_axis(own, places, signs.astype(np.float32), axis=1)
        self.vectors = np.hstack([vectors, own / np.sqrt(NONZERO)]).astype(np.float32)
        self.known = _Buckets()

    def of(self, text: str | None) -> np.ndarray:
        ids = _buckets_of(self.known, text)
        if not len(ids):
            return np.zeros(2 * WIDTH + 4, np.float32)
        total = np.zeros(2 * WIDTH)
        for at in range(0, len(ids), STEP):
            total += self.vectors[ids[at:at + STEP]].sum(axis=0)
        mean = total / len(ids)
        again = np.mean(ids[1:] == ids[:-1]) if len(ids) > 1 else 0.0
        return np.concatenate([mean, [np.linalg.norm(mean[:WIDTH]), np.linalg.norm(mean[WIDTH:]), again, np.log1p(len(ids)) / 10]]).astype(np.float32)


@dataclass
class Network:
    """Scaled features -> tanh layer -> logistic unit at a temperature."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.center) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Adam on four fifths of the rows, temperature by weighted log loss on the rest."""
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, rest = (order[:cut], order[cut:]) if len(x) >= 20 else (order, order)
    center, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z, goal, w = (x[rest] - center) / scale, y[rest], weight[rest] / weight[rest].mean()
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            a = np.tanh(z[batch] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(a @ params[2] + params[3][0], -40, 40)))
            d = w[batch] * (p - goal[batch]) / len(batch)
            back = np.outer(d, params[2]) * (1 - a * a)
            t += 1
            for i, g in enumerate((z[batch].T @ back + 1e-4 * params[0], back.sum(axis=0), a.T @ d + 1e-4 * params[2], np.array([d.sum()]))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - 0.003 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(center, scale, params[0], params[1], params[2], float(params[3][0]))
    logits = net.logits(x[held])

    def loss(temperature: float) -> float:
        p = np.clip(1 / (1 + np.exp(-np.clip(logits / temperature, -40, 40))), 1e-9, 1 - 1e-9)
        return float(-(weight[held] * (y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))).sum())

    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


_POOLS: dict[str, Pool] = {}


@dataclass
class Model:
    """Word vectors as a broadcast of fixed size, under a name of their own, and the network."""

    name: str
    vectors: Broadcast
    network: Network | None = None

    def pool(self) -> Pool:
        """One per worker and set of vectors."""
        if self.name not in _POOLS:
            _POOLS.clear()
            _POOLS[self.name] = Pool(self.vectors.value)
        return _POOLS[self.name]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE) -> Model | None:
    """The model from the labels for which `usable` (over doc_id) holds; None unless both classes occur."""
    told = staged(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label")).where(usable), "quality-labels")
    totals = {r[0]: r[1] for r in told.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    order = F.xxhash64("doc_id", F.lit("sample"))
    few = told.where("label = 1").orderBy(order).limit(size).union(told.where("label = 0").orderBy(order).limit(size))
    few = staged(few.withColumnRenamed("doc_id", "labelled"), "quality-sample-ids")
    model = Model(uuid4().hex, docs.sparkSession.sparkContext.broadcast(word_vectors(docs)))

    @F.pandas_udf("binary")
    def pooled(texts: pd.Series) -> pd.Series:
        pool = model.pool()
        return pd.Series([pool.of(t).tobytes() for t in texts])

    met = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("labelled"))  # 2 * size rows at most
    rows = met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", pooled("text").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if len({r["label"] for r in rows}) < 2:
        return None
    x, y = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64), np.array([float(r["label"]) for r in rows])
    weight = np.array([totals[int(v)] / (y == v).sum() for v in y])
    model.network = train(x, y, weight)
    return model


def quality(model: Model | None, text: str = "text") -> Column:
    """The score of a text column, 0 to 1."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        pool = model.pool()
        return pd.Series(model.network.probabilities(np.stack([pool.of(t) for t in texts]).astype(np.float64)) if len(texts) else [], dtype=float)

    return score(F.col(text))
