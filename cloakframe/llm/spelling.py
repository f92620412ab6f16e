"""The spelling of words by logistic mixing, for words that have no code of their own.

A word is spelled as its bytes and a space, bit by bit. Five predictors see hashed contexts (the
last 1, 2, 3 and 5 bytes, and all bytes of the word so far); each has counts of both bits in a
table of fixed size. Their log odds are combined by weights that gates choose (the bit's place in
its byte, and how often the longest context was seen), and a last table refines the result by what
was seen to follow such a prediction. Counts are sums over every distinct training word; weights
and the last table are learnt online, word block after word block in each task, each word leaving
its own count out, and the tasks' weights are averaged. The tables' size is fixed, so they may go
to every task; what is counted to make them grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of each predictor's slots: 1, 2, 3 and 5 bytes back, and the whole word so far.
BITS = (16, 18, 19, 19, 19)
BACK = (1, 2, 3, 5)
OFFSETS = np.cumsum([0] + [1 << b for b in BITS])
SLOTS = int(OFFSETS[-1])
N = len(BITS)
#: What is added to both counts before their log odds.
PRIOR = 0.4
#: Gates: 8 places in a byte by this many classes of the longest context's count.
SEEN = 8
GATES = 8 * SEEN
#: Cells of the last table for each gate, over log odds from -8 to 8.
CELLS = 33
WORDS_IN_BLOCK = 20_000
#: Words between two steps of the weights.
STEP_WORDS = 500
SHARD = 1 << 16
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


class Spelled:
    """The bits of some words with the slots that predict them: word, byte and contexts by position."""

    def __init__(self, words: list[bytes]):
        sizes = np.array([len(w) + 1 for w in words])
        self.n, self.starts = len(words), np.cumsum(sizes) - sizes
        self.byte = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
        at = np.arange(len(self.byte)) - np.repeat(self.starts, sizes)
        self.hashes = []
        for order in BACK:
            h = np.zeros(len(self.byte), np.uint64)
            for k in range(1, order + 1):
                before = np.zeros_like(h)
                before[k:] = self.byte[:-k] + np.uint64(1)
                before[at < k] = 0
                h = _mix(h + before) if order > 1 else before
            self.hashes.append(h)
        # The whole word so far: all words take their next byte together.
        whole = np.zeros(len(self.byte), np.uint64)
        on, h = np.arange(self.n), np.full(self.n, 7, np.uint64)
        for k in range(int(sizes.max()) if self.n else 0):
            on = on[sizes[on] > k]
            place = self.starts[on] + k
            whole[place] = h[on]
            h[on] = _mix(h[on] + self.byte[place] + np.uint64(1))
        self.hashes.append(whole)

    def bits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(place in the byte, slots [N, positions], bits) from the highest bit down."""
        for k in range(8):
            partial = (np.uint64(1) << np.uint64(k)) | (self.byte >> np.uint64(8 - k))
            slots, spread = np.empty((N, len(self.byte)), np.int64), partial * np.uint64(0x632BE59BD9B4E019)
            for i, h in enumerate(self.hashes):
                key = (h << np.uint64(8) | partial) if i == 0 else _mix(h + spread)
                key &= np.uint64((1 << BITS[i]) - 1)
                np.add(key.view(np.int64), OFFSETS[i], out=slots[i])
            yield k, slots, (self.byte >> np.uint64(7 - k) & np.uint64(1)).view(np.int64)


def add_counts(words: list[bytes], counts: np.ndarray) -> None:
    """Adds each word's bits to counts [2, SLOTS], once for each word."""
    flat = counts.reshape(-1)
    for _, slots, bits in Spelled(words).bits():
        np.add.at(flat, (slots + bits * SLOTS).ravel(), counts.dtype.type(1))


class LogOdds:
    """What counts [2, SLOTS] say, looked up: log odds of a one by bit and slot, and classes of the longest context's count.

    With out, what is looked up for a bit leaves one such bit of the slot out.
    """

    def __init__(self, counts: np.ndarray, out: bool):
        self.odds, self.seen = np.empty((2, SLOTS), np.float32), np.empty((2, 1 << BITS[-1]), np.uint8)
        for bit in (0, 1):
            n0, n1 = (np.maximum(counts[b].astype(np.float32) - (out and b == bit), 0) for b in (0, 1))
            np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)), out=self.odds[bit])
            self.seen[bit] = np.minimum(np.log2(n0[OFFSETS[N - 1] :] + n1[OFFSETS[N - 1] :] + 1), SEEN - 1)

    def inputs(self, slots: np.ndarray, bits: np.ndarray, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds [N, positions] and gates."""
        gate = self.seen.reshape(-1).take((slots[-1] - OFFSETS[N - 1]) + (bits << BITS[-1])).astype(np.int64)
        gate += place * SEEN
        return self.odds.reshape(-1).take(slots + bits * SLOTS, mode="wrap"), gate


def inputs(counts: np.ndarray, slots: np.ndarray, bits: np.ndarray, place: int, out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log odds [N, positions] and gates; with out, each position's own count is left out."""
    return LogOdds(counts, out).inputs(slots, bits, place)


def _cell(t: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(t + t) + CELLS // 2, 0, CELLS - 1).astype(np.int64)


def squash(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -20, 20)))


class Mixer:
    """Weights and last table, learnt online; how is w [GATES, N] and their curvature so far."""

    def __init__(self, w: np.ndarray | None = None, cells: np.ndarray | None = None):
        self.w = np.full((GATES, N), 0.3) if w is None else w
        self.curve = np.full((GATES, N), 20.0)
        self.cells = np.zeros((2, GATES * CELLS)) if cells is None else cells

    def learn(self, words: list[bytes], counts: np.ndarray | LogOdds) -> None:
        """Steps of the weights over some training words; each leaves its own count out."""
        odds = counts if isinstance(counts, LogOdds) else LogOdds(counts, True)
        for place, slots, bits in Spelled(words).bits():
            x, gate = odds.inputs(slots, bits, place)
            now = slice(place * SEEN, (place + 1) * SEEN)
            t = self._mixed(x, gate)
            p = squash(t)
            cell = _cell(t)
            cell += gate * CELLS
            cell += bits * (GATES * CELLS)
            self.cells += np.bincount(cell, minlength=2 * GATES * CELLS).reshape(2, -1)
            size = np.abs(x)
            gap, wide = bits.astype(np.float32) - p, p * (1 - p) * sum(size)
            # The sums by gate of what is gained and of its curvature.
            sums = ((gate - place * SEEN).astype(np.int8) == np.arange(SEEN, dtype=np.int8)[:, None]).astype(np.float32) @ np.concatenate((size * wide, x * gap)).T
            self.curve[now] += sums[:, :N]
            self.w[now] += sums[:, N:] / self.curve[now]

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(self.w.T, np.float32)
        return sum(w[i].take(gate) * x[i] for i in range(N))

    def log10(self, words: list[bytes], counts: np.ndarray | LogOdds, out: bool = False) -> np.ndarray:
        """log10 of each word's spelling; with out, each word leaves its own count out, as LogOdds do that were made so."""
        if not words:
            return np.empty(0)
        odds = counts if isinstance(counts, LogOdds) else LogOdds(counts, out)
        spelled = Spelled(words)
        total = np.zeros(len(spelled.byte))
        # A cell's own mean, held to its centre where little was seen.
        centre = squash((np.arange(CELLS) - CELLS // 2) / 2)
        n0, n1 = self.cells.reshape(2, GATES, CELLS)
        refined = ((n1 + 50 * centre) / (n0 + n1 + 50)).ravel()
        refined = refined.astype(np.float32)
        for place, slots, bits in spelled.bits():
            x, gate = odds.inputs(slots, bits, place)
            t = self._mixed(x, gate)
            p = np.clip((squash(t) + refined[gate * CELLS + _cell(t)]) / 2, 1e-7, 1 - 1e-7)
            total += np.log10(np.where(bits == 1, p, 1 - p))
        return np.add.reduceat(total, spelled.starts)


def _groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list[bytes]]:
    for batch in batches:
        words = batch.column(column).to_pylist()
        for a in range(0, len(words), WORDS_IN_BLOCK):
            yield words[a : a + WORDS_IN_BLOCK]


def context_counts(words: DataFrame) -> np.ndarray:
    """Counts of both bits by slot over all words (word binary), summed in the cluster.

    Each task sends its sums in shards; the driver gets one table of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SLOTS), np.uint32)
        for some in _groups(batches):
            add_counts(some, counts)
        flat = counts.astype("<f4").ravel()
        for shard in range(0, len(flat), SHARD):
            if flat[shard : shard + SHARD].any():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard // SHARD], pa.int32()), "sums": pa.array([flat[shard : shard + SHARD].tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[shard] = sums.get(shard, 0) + np.frombuffer(data, "<f4").astype(np.float64)
        for shard, total in sums.items():
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    shards = words.mapInArrow(count, "shard int, sums binary").repartition("shard").mapInArrow(add, "shard int, sums binary")
    out = np.zeros(2 * SLOTS, np.float32)
    got = shards.toArrow()
    for shard, sums in zip(got.column("shard").to_pylist(), got.column("sums").to_pylist(), strict=True):
        part = np.frombuffer(sums, "<f4")
        out[shard * SHARD : shard * SHARD + len(part)] = part
    return out.reshape(2, SLOTS)


def train_mixer(words: DataFrame, counts: np.ndarray) -> Mixer:
    """Every task learns from its words; weights are averaged by their curvature, cells added."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, odds = Mixer(), None
        for some in _groups(batches):
            odds = odds or LogOdds(shared.value, True)
            for a in range(0, len(some), STEP_WORDS):
                mixer.learn(some[a : a + STEP_WORDS], odds)
        share = mixer.curve - 20.0
        values = np.concatenate(((mixer.w * share).ravel(), share.ravel(), mixer.cells.ravel()))
        on = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(values[on])], names=["at", "x"])

    size = GATES * N
    values = np.zeros(2 * size + 2 * GATES * CELLS)
    got = words.mapInArrow(learn, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    values[got.column("at").to_numpy()] = got.column("x").to_numpy()
    weight, share = values[:size].reshape(GATES, N), values[size : 2 * size].reshape(GATES, N)
    w = np.where(share > 0, weight / np.maximum(share, 1e-9), 0.3)
    return Mixer(w, values[2 * size :].reshape(2, -1))
