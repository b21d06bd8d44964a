"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item, windows of its length slide over a document. Windows and items
have 64-bit SimHashes over their five-word shingles, repeats counted. Item fingerprints are
cut into eight blocks of eight bits; a table holds, for each block and each of its 256 values,
the items within two bits there. A window's candidates are the union of its eight entries:
whatever differs in at most 23 bits has a block with at most two, so none within that radius
is missed. Candidates within it are verified by the exact weighted similarity of their
shingle multisets (sum of minima over sum of maxima), 0.8 or more.

Windows without a single shingle of any item have similarity 0 and are not fingerprinted.

Words are runs between ASCII white space and punctuation, lower-cased. An item or a document
of fewer than five words is one shingle; a document shorter than an item is one window.
Null texts, empty texts and items without words match nothing. Repeated rows are judged row
by row, repeated items each on their own. The benchmark is measured: it is given to the tasks
in blocks of at most about BLOCK_BYTES of text, each block a pass of its own, so nothing that
is broadcast grows with it.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_RADIUS, RADIUS = 8, 2, 23
BLOCK_BYTES = 16_000_000
MATCH = "array<struct<item_id:string,similarity:double,distance:int,start_word:long,words:long>>"

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPACED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACED).split()


def _word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)


def _shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j:j + n] * _ODD[j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _bit_sums(shingles: np.ndarray) -> np.ndarray:
    """Row i: how often each bit is set in the first i shingles."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def _majority(ones: np.ndarray, total: int) -> np.ndarray:
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: list[bytes], b: list[bytes], k: int) -> float:
    """Weighted similarity of the multisets of k-word shingles."""
    x = Counter(tuple(a[i:i + k]) for i in range(len(a) - k + 1))
    y = Counter(tuple(b[i:i + k]) for i in range(len(b) - k + 1))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


class ItemIndex:
    """The items of one block: their shingles, and per length their fingerprints by Hamming block."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.ids, self.tokens = [], []
        for item_id, text in items:
            if tokens := words(text):
                self.ids.append(item_id)
                self.tokens.append(tokens)
        by_length: dict[int, list[int]] = {}
        for i, tokens in enumerate(self.tokens):
            by_length.setdefault(len(tokens), []).append(i)
        self.lengths, self.own, found = {}, {}, {}
        popcount = np.array([bin(v).count("1") for v in range(256)])
        values = np.arange(256)
        for length, members in by_length.items():
            k = min(SHINGLE, length)
            prints = []
            for i in members:
                shingles = _shingle_hashes(_word_hashes(self.tokens[i]), k)
                found.setdefault(k, []).append(shingles)
                self.own[i] = np.unique(shingles)
                prints.append(_majority(_bit_sums(shingles)[-1:], len(shingles))[0])
            prints = np.array(prints, np.uint64)
            blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
            near = popcount[values[None, :, None] ^ blocks.T[:, None, :]] <= BLOCK_RADIUS
            self.lengths[length] = (k, np.array(members), prints, near)
        self.shingles = {k: np.unique(np.concatenate(s)) for k, s in found.items()}
        self.filters = {}
        for k, s in self.shingles.items():
            self.filters[k] = np.zeros(1 << 20, bool)
            self.filters[k][s >> np.uint64(44)] = True

    def _hits(self, shingles: np.ndarray, k: int) -> np.ndarray:
        at = np.flatnonzero(self.filters[k][shingles >> np.uint64(44)])
        known = self.shingles[k]
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        return at[known[place] == shingles[at]]

    def matches(self, text: str | None) -> list[tuple]:
        tokens = words(text)
        best: dict[int, tuple] = {}
        hashes = _word_hashes(tokens)
        for k in self.shingles:
            if len(tokens) < k:
                continue
            shingles = _shingle_hashes(hashes, k)
            hits = self._hits(shingles, k)
            if not len(hits):
                continue
            reach = max(length for length, (of, *_) in self.lengths.items() if of == k)
            runs = np.split(hits, np.flatnonzero(np.diff(hits) > 2 * reach) + 1)
            for run in runs:
                first = max(0, int(run[0]) - reach)
                region = shingles[first:int(run[-1]) + reach]
                sums = _bit_sums(region)
                for length in (length for length, (of, *_) in self.lengths.items() if of == k):
                    self._windows(tokens, run, first, region, sums, length, best)
        return [(self.ids[i], *b) for i, b in sorted(best.items())]

    def _windows(self, tokens: list[bytes], hits: np.ndarray, first: int, region: np.ndarray, sums: np.ndarray, length: int, best: dict) -> None:
        """Windows of one length that hold a hit, against the items of that length.

        A candidate within the radius is verified unless the number of its shingles that the
        item has at all already bounds the similarity below the threshold.
        """
        k, members, prints, near = self.lengths[length]
        size = min(length, len(tokens))
        span = size - k + 1
        reached = np.zeros(len(tokens) - size + 2, np.int32)
        np.add.at(reached, np.clip(hits - span + 1, 0, len(reached) - 1), 1)
        np.add.at(reached, np.clip(hits + 1, 0, len(reached) - 1), -1)
        starts = np.flatnonzero(np.cumsum(reached)[:-1] > 0)
        if not len(starts):
            return
        windows = _majority(sums[starts - first + span] - sums[starts - first], span)
        blocks = windows.view(np.uint8).reshape(-1, BLOCKS)
        candidate = near[0][blocks[:, 0]]
        for b in range(1, BLOCKS):
            candidate = candidate | near[b][blocks[:, b]]
        at, of = np.nonzero(candidate)
        distance = np.bitwise_count(windows[at] ^ prints[of])
        for m in np.unique(of[distance <= RADIUS]).tolist():
            item = int(members[m])
            close = np.flatnonzero((of == m) & (distance <= RADIUS))
            begins = starts[at[close]]
            held = np.concatenate([[0], np.cumsum(np.isin(region, self.own[item]))])
            shared = held[begins - first + span] - held[begins - first]
            possible = shared >= SIMILARITY * (span + length - k + 1 - shared) - 1e-6
            for start, d in zip(begins[possible].tolist(), distance[close[possible]].tolist()):
                if item in best and best[item][0] == 1.0:
                    break
                s = similarity(tokens[start:start + size], self.tokens[item], k)
                if s >= SIMILARITY and (item not in best or s > best[item][0]):
                    best[item] = (s, int(d), start, size)


_INDEXES: dict[str, ItemIndex] = {}


def _index(name: str, items: Broadcast) -> ItemIndex:
    """One index per worker and block, built when first needed."""
    if name not in _INDEXES:
        _INDEXES[name] = ItemIndex(items.value)
    return _INDEXES[name]


def _blocks(benchmark: DataFrame) -> list[tuple[str, Broadcast]]:
    """The items in blocks of bounded size, each with a name of its own."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block"))
    context = benchmark.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast([(r[0], r[1]) for r in items.where(F.col("block") == b).collect()])) for b in range(n)]


def _found(name: str, items: Broadcast, text: str) -> Column:
    @F.pandas_udf(MATCH)
    def found(texts: pd.Series) -> pd.Series:
        index = _index(name, items)
        names = ("item_id", "similarity", "distance", "start_word", "words")
        return pd.Series([[dict(zip(names, m)) for m in index.matches(t)] for t in texts])

    return found(F.col(text))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, distance, start_word, words): the best window per document and item it leaks."""
    out = None
    for name, items in _blocks(benchmark):
        part = docs.select("doc_id", F.explode(_found(name, items, "text")).alias("m"))
        out = part if out is None else out.union(part)
    kind = benchmark.schema["item_id"].dataType
    return out.select("doc_id", F.col("m.item_id").cast(kind).alias("item_id"), "m.similarity", "m.distance", "m.start_word", "m.words")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item."""
    for name, items in _blocks(benchmark):
        docs = docs.where(F.size(_found(name, items, "text")) == 0)
    return docs
