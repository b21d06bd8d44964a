"""LM scoring by deleted interpolation of word n-grams.

    p(w | u) = l2 * c(u,w)/c(u) + l1 * c(w)/N + l0 / (V+1)

u is the word before (or the start of the text). The weights l depend on the bucket of
c(u), its power of two, and are learned by expectation-maximisation on the counts of a
deleted part of the training documents (one in DELETED_PART, by hash of doc_id), against
counts from the rest; scores then use the counts of all training documents.

How it runs: texts are read once and written as chunks of about CHUNK_TOKENS tokens, as
indices into the chunk's own words. Each chunk asks for the counts of its distinct words and
word pairs, as sorted 64-bit hashes cut into ranges; per range the training counts of all
chunks are summed and every chunk gets its answers back in its own order. So no table of
n-grams is ever broadcast or collected, a frequent n-gram costs one entry per chunk, and a
task holds one chunk or one range. Only per-range totals (N, V) and a histogram of
quantised probabilities, bounded by its bins, reach the driver.

Null texts are empty: one end token. Rows that share a doc_id, equal rows and rows without
one (whose id counts as the empty text) each count and are scored. Without training
documents, or without a deleted part, the weights are a third each. An empty table gives an
empty result. A text much longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import id_remainder
from logloom.operators.stages import staged

CHUNK_TOKENS, RANGE_TOKENS = 1_000_000, 2_000_000
TRAIN, DELETED, HELD_OUT = 0, 1, 2
DELETED_PART, EM_ROUNDS, BINS_PER_DECADE = 16, 40, 10
MISSING = 9_999
END_WORD = b"\n"
_END = np.uint64(xxhash.xxh64_intdigest(END_WORD))
_START = np.uint64(xxhash.xxh64_intdigest(b"\n\n"))

CHUNKS = "chunk long, role int, tokens long, doc_ids array<long>, lengths array<int>, words binary, stream binary"
ASKS = "range int, chunk long, role int, grams int, keys binary, counts binary"
ANSWERS = "chunk long, grams int, range int, kept binary, full binary, n_kept long, v_kept long, n_full long, v_full long"
BINS = "context int, single int, pair int, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _pack(values: np.ndarray) -> bytes:
    """Compressed by byte planes: high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


class _Chunk:
    """Documents of one role on their way into a row."""

    def __init__(self):
        self.words, self.ids, self.lengths, self.parts, self.tokens = _Vocabulary(), [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        tokens = (text or "").encode().lower().split()
        tokens.append(END_WORD)
        self.parts.append(np.fromiter(map(self.words.__getitem__, tokens), np.uint32, len(tokens)))
        self.ids.append(doc_id)
        self.lengths.append(len(tokens))
        self.tokens += len(tokens)

    def row(self, chunk: int, role: int) -> dict:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return {"chunk": chunk * 4 + role, "role": role, "tokens": self.tokens, "doc_ids": self.ids, "lengths": self.lengths,
                "words": _pack_sorted(hashes[order]), "stream": _pack(rank[np.concatenate(self.parts)])}


def _table(rows: list[dict], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])
    return pa.Table.from_pylist(rows, schema=schema)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, role, part -> CHUNKS."""
    open_chunks, number, part = {}, 0, 0
    for batch in batches:
        for doc_id, text, role, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
            chunk = open_chunks.setdefault(role, _Chunk())
            chunk.add(doc_id, text)
            if chunk.tokens >= CHUNK_TOKENS:
                yield from _table([open_chunks.pop(role).row((part << 24) + number, role)], CHUNKS).to_batches()
                number += 1
    for role in sorted(open_chunks):
        yield from _table([open_chunks[role].row((part << 24) + number, role)], CHUNKS).to_batches()
        number += 1


def _grams(words: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token: the index of its context in `words` (len(words) for the start) and the hash of the pair."""
    context = np.empty(len(stream), np.int64)
    context[1:] = stream[:-1]
    context[np.cumsum(lengths) - lengths] = len(words)
    known = np.append(words, _START)
    pairs = known[context] * np.uint64(0x9E3779B97F4A7C15) + words[stream]
    pairs ^= pairs >> np.uint64(31)
    pairs *= np.uint64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> np.uint64(29)
    return context, pairs


def _decoded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpack_sorted(row["words"]), _unpack(row["stream"], np.uint32), np.array(row["lengths"], np.int64)


def _asking(ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, stream, lengths = _decoded(row)
                pairs, pair_counts = np.unique(_grams(words, stream, lengths)[1], return_counts=True)
                out = []
                for grams, keys, counts in ((1, words, np.bincount(stream, minlength=len(words))), (2, pairs, pair_counts)):
                    of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    cuts = np.flatnonzero(np.diff(of)) + 1
                    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                        told = _pack(counts[a:b].astype(np.uint32)) if row["role"] != HELD_OUT else None
                        out.append({"range": int(of[a]), "chunk": row["chunk"], "role": row["role"], "grams": grams, "keys": _pack_sorted(keys[a:b]), "counts": told})
                yield from _table(out, ASKS).to_batches()
    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """One range: sums of the training counts, sent back in each chunk's order."""
    out = []
    rows = asked.to_pylist()
    for grams in (1, 2):
        own = [r for r in rows if r["grams"] == grams]
        if not own:
            continue
        keys = [_unpack_sorted(r["keys"]) for r in own]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        kept, full = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        ends = np.cumsum([len(k) for k in keys])
        places = np.split(place, ends[:-1])
        for r, at in zip(own, places):
            if r["counts"] is not None:
                counts = _unpack(r["counts"], np.uint32)
                full[at] += counts
                if r["role"] == TRAIN:
                    kept[at] += counts
        for r, at in zip(own, places):
            out.append({"chunk": r["chunk"], "grams": grams, "range": r["range"], "kept": _pack(kept[at]) if r["role"] == DELETED else None, "full": _pack(full[at])})
        if grams == 1:
            out.append({"chunk": -1, "grams": 0, "range": own[0]["range"], "n_kept": int(kept.sum()), "v_kept": int((kept > 0).sum()), "n_full": int(full.sum()), "v_full": int((full > 0).sum())})
    return _table(out, ANSWERS)


def _counts(row: dict, answers: pa.Table, which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of a chunk: its count, its context's, the pair's; and the documents' first tokens."""
    words, stream, lengths = _decoded(row)
    context, pairs = _grams(words, stream, lengths)
    place = np.unique(pairs, return_inverse=True)[1]
    parts = sorted(answers.select(["grams", "range", which]).to_pylist(), key=lambda a: (a["grams"], a["range"]))
    single, pair = (np.concatenate([_unpack(a[which], np.int64) for a in parts if a["grams"] == g]) for g in (1, 2))
    # every text starts once and ends once, so the start was seen as often as the end
    contexts = np.append(single, single[np.searchsorted(words, _END)])
    return single[stream], contexts[context], pair[place], np.cumsum(lengths) - lengths


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(np.float64))[1]


def _binned(n: int):
    def bins(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            single, context, pair, _ = _counts(row, right, "kept")
            with np.errstate(divide="ignore", invalid="ignore"):
                p1, p2 = single / max(n, 1), np.where(context > 0, pair / np.maximum(context, 1), 0)
                q1, q2 = (np.where(p > 0, np.round(np.log10(np.where(p > 0, p, 1)) * BINS_PER_DECADE), MISSING).astype(np.int64) for p in (p1, p2))
            cells, counts = np.unique(np.stack([_bucket(context), q1, q2]), axis=1, return_counts=True)
            out += [{"context": int(c), "single": int(a), "pair": int(b), "n": int(k)} for (c, a, b), k in zip(cells.T, counts)]
        return _table(out, BINS)
    return bins


def learned_weights(bins: list[tuple[int, int, int, int]], v: int) -> dict[int, np.ndarray]:
    """Weights (pair, single, uniform) per context bucket by EM on (context, single bin, pair bin, n); -1 has those for all."""
    even = np.full(3, 1 / 3)
    if not bins:
        return {-1: even}
    cells = np.array(bins, np.int64)

    def maximised(rows: np.ndarray, prior: np.ndarray, strength: float) -> np.ndarray:
        p = np.stack([10.0 ** np.where(rows[:, c] == MISSING, -np.inf, rows[:, c] / BINS_PER_DECADE) for c in (2, 1)] + [np.full(len(rows), 1 / (v + 1))], axis=1)
        weights = prior.copy()
        for _ in range(EM_ROUNDS):
            share = p * weights
            share /= share.sum(axis=1, keepdims=True)
            found = (share * rows[:, 3:4]).sum(axis=0) + strength * prior
            weights = np.maximum(found / found.sum(), 1e-9)
        return weights / weights.sum()

    out = {-1: maximised(cells, even, 0.0)}
    return out | {int(c): maximised(cells[cells[:, 0] == c], out[-1], 5.0) for c in np.unique(cells[:, 0])}


def _scoring(n: int, v: int, weights: dict[int, np.ndarray]):
    table = np.stack([weights.get(c, weights[-1]) for c in range(66)])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            single, context, pair, starts = _counts(row, right, "full")
            w = table[_bucket(context)]
            p = w[:, 0] * np.where(context > 0, pair / np.maximum(context, 1), 0) + w[:, 1] * single / max(n, 1) + w[:, 2] / (v + 1)
            base = np.add.reduceat(np.log10((single + 1) / (n + v + 1)), starts)
            logs, known = np.add.reduceat(np.log10(p), starts), np.add.reduceat((single > 0).astype(np.int64), starts)
            for d, k, b, s, length in zip(row["doc_ids"], known.tolist(), base.tolist(), logs.tolist(), row["lengths"]):
                out.append({"doc_id": d, "held_out": row["role"] == HELD_OUT, "n_tokens": length, "n_known": k, "base_score": b, "score": s})
        return _table(out, SCORES)
    return score


def score(docs: DataFrame, held_out_of: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs."""
    deleted = F.pmod(F.xxhash64("doc_id", F.lit("deleted")), F.lit(DELETED_PART)) == 0
    role = F.when(id_remainder(held_out_of) == held_out, HELD_OUT).when(deleted, DELETED).otherwise(TRAIN)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role.alias("role"), F.spark_partition_id().cast("long").alias("part"))
    chunks = staged(read.mapInArrow(_chunked, CHUNKS), "lm-chunks")
    ranges = int(max(1, -(-(chunks.agg(F.sum("tokens")).first()[0] or 0) // RANGE_TOKENS)))
    asks = chunks.select("chunk", "role", "lengths", "words", "stream").mapInArrow(_asking(ranges), ASKS)
    answers = staged(asks.groupBy("range").applyInArrow(_answer, ANSWERS), "lm-answers")
    totals = answers.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_kept", "v_kept", "n_full", "v_full")]).first()
    told = answers.where("chunk >= 0").select("chunk", "grams", "range", "kept", "full")

    part = chunks.where(F.col("role") == DELETED).groupBy("chunk").cogroup(told.where(F.col("chunk") % 4 == DELETED).groupBy("chunk"))
    bins = part.applyInArrow(_binned(totals.n_kept), BINS).groupBy("context", "single", "pair").agg(F.sum("n").alias("n")).collect()
    weights = learned_weights([tuple(b) for b in bins], totals.v_kept)
    scored = chunks.groupBy("chunk").cogroup(told.drop("kept").groupBy("chunk")).applyInArrow(_scoring(totals.n_full, totals.v_full, weights), SCORES)
    return scored.withColumn("train_tokens", F.lit(totals.n_full).cast("long"))
