"""Operator 6: language-model scores by online logistic context mixing.

Tokens are the text's words with A-Z in lower case, and an end. Two followers foretell a token:

* one tells what came after the last place in this text with the same two words before;
* one tells what came, in any other training text, after the same four words. Places are anchors
  if the hash of the four words before says so (one in ANCHOR); their following NEXT words are
  matched over the whole corpus, so what is gathered for it grows with the corpus.

Whether the token is the one that is foretold (the corpus's follower first) is a bit by itself; its
probability is counted by follower and by how many tokens in a row it was right before. All other
tokens are spelled in a prefix code: the VOCABULARY commonest training words, the end and an escape
have one by their counts. Its bits are foretold by predictors that see the node of the code, with
hashed contexts of earlier words: none, the last, the last two. Each has counts of both bits, added
up over all training texts; a training text leaves its own bit out of them.

Their log odds are combined by weights that gates choose (how far the code has come, the longest
context that was seen, which follower was wrong), learnt online, chunk after chunk in each task, on
all training texts; the tasks' weights are averaged by their curvature. A table then refines each prediction by what was seen to follow such a one, and the text
itself adapts them further: for each state of the followers a gain, learnt from the bits before,
sharpens or flattens the predictions. Bits per byte are the sum over the text's bits.

An escaped word that was seen in the training texts (its own place left out) has its share of the
other words' counts; what they leave, the share of words seen once, goes to the others by their
spelling's probability, which mixes hashed contexts of bytes (see spelling).

A text's language and source are no inputs. Words, counts and anchors meet in shuffles; a task's
block of texts has TEXT_IN_BLOCK bytes, so that what meets there is bounded. A null text is an
empty one: it has only the end. Without training rows all counts are zero. Repeated rows are scored
each, very long texts as a whole; rows without a doc_id are learnt from. An empty table gives an
empty one, and columns besides doc_id and text play no part.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import spelling
from cloakframe.llm.common import discard, fold, prepare, stored

#: Words with a code, and the longest such word in bytes.
VOCABULARY = 60_000
LONGEST = 64
#: One place in so many is an anchor, by the words before it; so many words after it are matched.
ANCHOR = 24
BEFORE = 4
NEXT = 24
#: log2 of the slots of a context's counts: as many as tokens, up to this.
WIDEST = 21
PRIOR = 0.4
#: Codes' places, contexts seen and states of the followers that make a gate.
PLACES, SEEN, STATES = 6, 3, 3
GATES = PLACES * SEEN * STATES
#: Contexts with counts, and predictors in all.
CONTEXTS = 3
N = CONTEXTS
RUNS = 8
#: Cells of the last table for each gate, over log odds from -8 to 8.
CELLS = 33
#: How firmly a text's gains are held to one, in bits of full doubt.
HELD = 20.0
TEXT_IN_BLOCK = 12 << 20
DOCS_IN_BLOCK = 1 << 18
#: Tokens whose contexts are made at once, and tokens between two steps of the weights.
GROUP = 1 << 17
STEP = 1 << 15
SHARD = 1 << 17
#: What a follower foretells besides a code's number: the very same escaped word, and nothing.
SAME, NOTHING = 0xFFFE, 0xFFFF
#: log2 of a run's length plus one, up to the longest that are told apart.
RUN_OF = np.log2(np.maximum(np.arange((1 << (RUNS - 1)) + 1), 1)).astype(np.int64)
_M = np.uint64(0x9E3779B97F4A7C15)
_G = np.uint64(0x632BE59BD9B4E019)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M
    return h ^ (h >> np.uint64(29))


SEED = 42


def word_hash(word: bytes) -> int:
    """The same as Spark's xxhash64, without a sign."""
    return xxhash.xxh64_intdigest(word, SEED)


#: The end's hash; no word is empty.
END_HASH = word_hash(b"")


def short(h: np.ndarray) -> np.ndarray:
    """24 bits of words' hashes, never zero."""
    return np.maximum(h >> np.uint64(40), np.uint64(1)).astype(np.uint32)


class Code:
    """A prefix code of least length for symbols 0 to size - 1: path[k, s] is the node before bit k, -1 after the last."""

    def __init__(self, counts: list[int]):
        self.size = len(counts)
        heap = [(c, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = np.full(2 * self.size - 1, -1), np.zeros(2 * self.size - 1, np.uint8)
        for node in range(self.size, 2 * self.size - 1):
            for b in (0, 1):
                c, k = heapq.heappop(heap)
                parent[k], side[k] = node, b
                total = c if b == 0 else total + c
            heapq.heappush(heap, (total, node))
        upward, at = [], np.arange(self.size)
        while (parent[at] >= 0).any():
            live = parent[at] >= 0
            upward.append((live, np.where(live, parent[at], 0), side[at]))
            at = np.where(live, parent[at], at)
        self.length = sum((x[0] for x in upward), np.zeros(self.size, np.int64)).astype(np.uint8)
        self.path = np.full((len(upward), self.size), -1, np.int32)
        self.bits = np.zeros((len(upward), self.size), np.uint8)
        for k, (live, node, bit) in enumerate(upward):
            on = np.flatnonzero(live)
            self.path[self.length[on] - 1 - k, on], self.bits[self.length[on] - 1 - k, on] = node[on] - self.size, bit[on]
        #: Places of the symbols among all, the longest codes first.
        self.rank = np.empty(self.size, np.uint16)
        self.rank[np.argsort(-self.length.astype(np.int64), kind="stable")] = np.arange(self.size)


class Group:
    """Pieces of texts side by side: (ids, one, other, a, b, train) each, tokens a to b of a text."""

    def __init__(self, parts: list[tuple], size: int):
        sizes = np.array([b - a for _, _, _, a, b, _ in parts])
        self.starts, self.n = np.cumsum(sizes) - sizes, int(sizes.sum())
        # Two tokens before each piece, or size where the text begins, are context only.
        before = [np.concatenate((np.full(max(0, 2 - a), size), ids[max(0, a - 2) : a])) for ids, _, _, a, _, _ in parts]
        whole = np.concatenate([x for p, h in zip(parts, before, strict=True) for x in (h, p[0][p[3] : p[4]])]).astype(np.int64)
        at = np.arange(self.n) + 2 * (1 + np.repeat(np.arange(len(parts)), sizes))
        self.ids = whole[at]
        self.followers = [np.concatenate([p[k][p[3] : p[4]] for p in parts]) for k in (1, 2)]
        self.train = np.repeat(np.array([p[5] for p in parts], np.uint16), sizes)
        self.piece = np.repeat(np.arange(len(parts)), sizes)
        w = [whole[at - k].astype(np.uint64) + np.uint64(1) for k in (1, 2)]
        h1 = _mix(w[0] * _G)
        self.contexts = [h1, _mix(h1 + w[1])]
        escape = size - 1
        one, other = self.followers
        hits = [np.where(self.ids == escape, f == SAME, f == self.ids) for f in (one, other)]
        # The follower that foretells the token (2 for none), whether it's right, and how long it was.
        self.who, self.hits = np.where(other != NOTHING, 1, np.where(one != NOTHING, 0, 2)), hits
        self.right = np.where(self.who == 1, hits[1], hits[0] & (self.who == 0))
        self.state = (self.who + 1) % 3
        self.escapes = np.flatnonzero((self.ids == escape) & ~self.right)

    @cached_property
    def run(self) -> np.ndarray:
        runs = [self._runs(h) for h in self.hits]
        return np.where(self.who == 1, runs[1], runs[0])

    def _runs(self, hit: np.ndarray) -> np.ndarray:
        """log2 of how many tokens in a row were foretold right before each token of a piece."""
        at = np.arange(self.n, dtype=np.int32)
        last = np.maximum.accumulate(np.where(hit, np.int32(-1), at))
        last = np.maximum(np.concatenate((np.full(1, -1, np.int32), last[:-1])), (self.starts - 1).astype(np.int32)[self.piece])
        return RUN_OF[np.minimum(at - last, len(RUN_OF) - 1)]

    def levels(self, code: Code, a: int, b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, tokens from a to b that no follower foretells and whose code has a bit k, their nodes, their bits).

        Those with the longest codes come first, so a level's tokens are the first ones of the level before.
        """
        on = self.spelled(code, a, b)
        s = self.ids[on]
        shorter = np.cumsum(np.bincount(code.length[s], minlength=len(code.path)))
        for k in range(len(code.path)):
            n = len(on) - shorter[k]
            if not n:
                return
            yield k, on[:n], code.path[k].take(s[:n]), code.bits[k].take(s[:n])

    def spelled(self, code: Code, a: int, b: int) -> np.ndarray:
        """Tokens from a to b that no follower foretells, those with the longest codes first and like ones together."""
        on = np.flatnonzero(~self.right[a:b]) + a
        return on[np.argsort(code.rank[self.ids[on]], kind="stable")]


def slots(hashes: list[np.ndarray], wide: list[int], node: np.ndarray) -> list[np.ndarray]:
    """For each hashed context the slots of its counts at these nodes; hashes are those of the first level's tokens."""
    at, out = node.astype(np.uint64), []
    at *= _G
    for h, width in zip(hashes, wide, strict=True):
        x = h[: len(at)] ^ at
        x *= _M
        x >>= np.uint64(64 - width)
        out.append(x.view(np.int64))
    return out


def widths(tokens: int) -> list[int]:
    """log2 of the slots of the two hashed contexts."""
    w = min(WIDEST, max(12, math.ceil(math.log2(tokens + 1))))
    return [w, w]


class Counts:
    """Counts of both bits by context and slot, and of followers' tokens by run."""

    def __init__(self, code: Code, wide: list[int]):
        self.code, self.wide = code, wide
        self.shapes = [(code.size,), *[(1 << w, 2) for w in wide], (2, RUNS, 2)]
        self.size = sum(math.prod(s) for s in self.shapes)

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in self.shapes])
        return [x.reshape(s) for x, s in zip(np.split(flat, ends[:-1]), self.shapes, strict=True)]

    def add(self, g: Group, flat: np.ndarray) -> None:
        parts = self.split(flat)
        # Without a context the bits at a node are those of the symbols beyond it, so symbols are counted.
        parts[0] += np.bincount(g.ids[~g.right], minlength=self.code.size).astype(np.uint32)
        tables = [p.reshape(-1) for p in parts[1:CONTEXTS]]
        for a in range(0, g.n, STEP):
            for k, on, node, bit in g.levels(self.code, a, min(a + STEP, g.n)):
                if k == 0:
                    hashes = [h[on] for h in g.contexts]
                for table, slot in zip(tables, slots(hashes, self.wide, node), strict=True):
                    slot += slot
                    slot += bit
                    np.add.at(table, slot, np.uint32(1))
        on = g.who < 2
        parts[-1] += np.bincount((g.who * RUNS + g.run)[on] * 2 + g.right[on], minlength=4 * RUNS).reshape(2, RUNS, 2).astype(np.uint32)


class Model:
    """The code, the counts, the weights and the last table."""

    def __init__(self, code: Code, wide: list[int], tables: list[np.ndarray], same: np.ndarray, w: np.ndarray | None = None, cells: np.ndarray | None = None):
        self.code, self.wide, self.tables = code, wide, tables
        self.same = (same[..., 1] + 0.5) / (same.sum(axis=-1) + 1)
        self.w = np.full((GATES, N), 0.3) if w is None else w
        #: Bits that followed, by gate and their log odds.
        self.cells = np.zeros(GATES * CELLS) if cells is None else cells
        #: Log odds that are looked up.
        self.kept: dict[str, list] = {}

    @staticmethod
    def of(code: Code, wide: list[int], flat: np.ndarray) -> Model:
        symbols, *counts, same = Counts(code, wide).split(flat)
        nodes = np.zeros((max(1, code.size - 1), 2), np.int64)
        for path, bits in zip(code.path, code.bits, strict=True):
            on = path >= 0
            np.add.at(nodes, (path[on], bits[on]), symbols[on])
        tables = []
        for p in (nodes, *counts):
            # 16 bits for each count; beyond them only the ratio is kept, and what was seen stays above zero.
            most = np.maximum(p.max(axis=1, keepdims=True), 1)
            small = np.where(most > 65535, np.maximum(p * (65535 / most), p > 0), p)
            tables.append(small.astype(np.uint16))
        return Model(code, wide, tables, same.astype(float))

    def learn(self, g: Group, curve: np.ndarray) -> None:
        """Steps of the weights over a group, and what followed each prediction."""
        looked = LogOdds(self, g)
        room, every = np.empty((2 * N, STEP), np.float32), np.arange(SEEN * STATES, dtype=np.int8)[:, None]
        for a in range(0, g.n, STEP):
            for k, x, gates, t, cell in looked.levels(g, a, min(a + STEP, g.n)):
                p = squash(np.clip(t, -20, 20, out=t))
                self.cells += np.bincount(cells_of(cell, t), minlength=GATES * CELLS)
                miss, rows = 1 - p, room[:, : len(p)]
                p *= miss
                np.abs(x, out=rows[:N])
                p *= rows[0] + rows[1] + rows[2]
                rows[:N] *= p
                np.multiply(x, miss, out=rows[N:])
                # The sums by gate of what is gained and of its curvature.
                sums = (gates.astype(np.int8) == every).astype(np.float32) @ rows.T
                now = slice(min(k, PLACES - 1) * SEEN * STATES, (min(k, PLACES - 1) + 1) * SEEN * STATES)
                curve[now] += sums[:, :N]
                self.w[now] += sums[:, N:] / curve[now]

    def refined(self) -> np.ndarray:
        """How often a bit followed that had such log odds, against the other one; held to what they say where little was seen."""
        centre = spelling.squash((np.arange(CELLS) - CELLS // 2) / 2)
        n = self.cells.reshape(GATES, CELLS)
        return ((n + 50 * centre) / (n + n[:, ::-1] + 50)).ravel().astype(np.float32)

    def log10(self, g: Group, rest: np.ndarray, going_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each piece's probability; rest has that of each escaped word that no follower foretold.

        going_on is what the first piece's text has learnt of its gains so far; the last piece's is returned.
        """
        refined, out = self.refined(), np.zeros(g.n)
        looked = LogOdds(self, g)
        sums = np.zeros((2, STATES)) if going_on is None else going_on
        for a in range(0, g.n, STEP):
            b = min(a + STEP, g.n)
            on = g.spelled(self.code, a, b)
            at = g.state[on] * (b - a) + (on - a)
            seen, doubt, gap = [], np.zeros(len(on), np.float32), np.zeros(len(on), np.float32)
            for _, _, _, t, cell in looked.levels(g, a, b):
                p = squash(np.clip(t, -20, 20, out=t))
                seen.append((t, cell))
                miss = 1 - p
                miss *= t
                gap[: len(t)] += miss
                p *= miss
                p *= t
                doubt[: len(t)] += p
            learnt = np.zeros((2, STATES, b - a))
            learnt.reshape(2, -1)[0, at], learnt.reshape(2, -1)[1, at] = gap, doubt
            # What each token's text has learnt before it.
            upto = np.cumsum(learnt, axis=2)
            before = upto - learnt
            own = g.piece[a:b]
            first = np.maximum(g.starts[own] - a, 0)
            before -= before[:, :, first]
            cut = own == g.piece[a]
            if g.starts[g.piece[a]] < a or a == 0:
                before[:, :, cut] += sums[:, :, None]
            last = first[-1]
            fresh = upto[:, :, -1] - (upto - learnt)[:, :, last]
            sums = fresh + sums if own[-1] == own[0] and (g.starts[own[0]] < a or a == 0) else fresh
            gains = np.clip(1 + before[0] / (before[1] + HELD), 0.5, 2).astype(np.float32)
            gains, product = gains.reshape(-1)[at], np.ones(len(on))
            for k, (t, cell) in enumerate(seen):
                t *= gains[: len(t)]
                p = squash(t)
                p += refined.take(cells_of(cell, t))
                p *= np.float32(0.5)
                product[: len(t)] *= np.maximum(p, np.float32(1e-7), out=p)
                if k % 32 == 31:
                    # Before the products leave what a double holds.
                    out[on] += np.log10(product)
                    product[:] = 1
            out[on] += np.log10(product)
        p = self.same[np.minimum(g.who, 1), g.run]
        out += np.where(g.who == 2, 0, np.log10(np.where(g.right, p, 1 - p)))
        out[g.escapes] += rest
        return np.add.reduceat(out, g.starts), sums


class LogOdds:
    """What a model's counts say, looked up: for each context the log odds that each bit follows at each slot.

    The lowest bit of such a number tells whether the slot was seen. Training texts leave their own bit
    out. The model keeps what the last group needed: texts of one kind need half of what both need.
    """

    def __init__(self, model: Model, g: Group):
        self.model, self.own = model, np.unique(g.train).tolist()
        if model.kept.get("own") != self.own:
            model.kept.clear()
            model.kept.update(own=self.own, tables=[self._table(pairs) for pairs in model.tables])
        self.tables = model.kept["tables"]

    def _table(self, pairs: np.ndarray) -> np.ndarray:
        """[own, slot, bit] in one row."""
        out = np.empty((len(self.own), len(pairs), 2), np.float32)
        for rows, own in zip(out, self.own, strict=True):
            for bit in (0, 1):
                hit, miss = pairs[:, bit] - np.minimum(pairs[:, bit], np.uint16(own)), pairs[:, 1 - bit]
                odds = np.log((hit + np.float32(PRIOR)) / (miss + np.float32(PRIOR)))
                marked = odds.view(np.uint32)
                marked &= np.uint32(0xFFFFFFFE)
                marked |= (hit | miss) > 0
                rows[:, bit] = odds
        return out.ravel()

    def levels(self, g: Group, a: int, b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(k, log odds [N, tokens] of the bits that did follow, gates among the place's, mixed log odds, cells of even odds)."""
        m, room = self.model, np.empty((N, b - a), np.float32)
        for k, on, node, bit in g.levels(m.code, a, b):
            n = len(on)
            if k == 0:
                hashes, state = [h[on] for h in g.contexts], g.state[on]
                own = [g.train[on] * np.int64(2 * len(pairs)) for pairs in m.tables] if len(self.own) > 1 else []
            bit, x = bit.astype(np.int64), room[:, :n]
            for i, slot in enumerate([node.astype(np.int64), *slots(hashes, m.wide, node)]):
                slot += slot
                slot += bit
                if own:
                    slot += own[i][:n]
                # All are within the table; wrap is the mode that looks least.
                self.tables[i].take(slot, out=x[i], mode="wrap")
            last, two = x[1].view(np.uint32) & np.uint32(1), x[2].view(np.uint32) & np.uint32(1)
            two += two
            gates = np.maximum(last, two, out=two) * np.int64(STATES)
            gates += state[:n]
            place = min(k, PLACES - 1) * SEEN * STATES
            t = np.zeros(n, np.float32)
            for i in range(N):
                t += m.w[place : place + SEEN * STATES, i].astype(np.float32).take(gates) * x[i]
            yield k, x, gates, t, CELL_OF[place : place + SEEN * STATES].take(gates)


def squash(t: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-t)) for log odds that aren't too far from zero."""
    p = np.negative(t)
    np.exp(p, out=p)
    p += np.float32(1)
    return np.reciprocal(p, out=p)


#: The cell of even odds of each gate.
CELL_OF = (np.arange(GATES) * CELLS + CELLS // 2).astype(np.float32)


def cells_of(even: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The last table's cells for log odds t."""
    x = t + t
    np.rint(x, out=x)
    np.clip(x, -(CELLS // 2), CELLS // 2, out=x)
    x += even
    return x.astype(np.int64)


READY = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, ids binary, one binary, other binary, rest binary"


def groups(batch: pa.RecordBatch, size: int, training_only: bool) -> Iterator[tuple[Group, np.ndarray, list[tuple[int, int, int]]]]:
    """Groups of a batch of READY rows, what is left of their escapes that aren't foretold, and their pieces (row, a, b)."""
    held = batch.column(1).to_pylist()
    ids, one, other = ([np.frombuffer(x, "<u2") for x in batch.column(k).to_pylist()] for k in (6, 7, 8))
    rest = [np.frombuffer(x, "<f4") for x in batch.column(9).to_pylist()]
    pieces, n = [], 0

    def made() -> tuple[Group, np.ndarray, list[tuple[int, int, int]]]:
        g = Group([(ids[r], one[r], other[r], a, b, not held[r]) for r, a, b in pieces], size)
        left = [rest[r][x : x + int((ids[r][a:b] == size - 1).sum())] for r, a, b in pieces for x in [int((ids[r][:a] == size - 1).sum())]]
        return g, np.concatenate(left)[~g.right[g.ids == size - 1]], pieces

    for r in range(batch.num_rows):
        if training_only and held[r]:
            continue
        for a in range(0, len(ids[r]), GROUP):
            b = min(a + GROUP, len(ids[r]))
            if pieces and n + b - a > GROUP:
                yield made()
                pieces, n = [], 0
            pieces.append((r, a, b))
            n += b - a
    if pieces:
        yield made()


def count(ready: DataFrame, code: Code, wide: list[int]) -> Model:
    """The counts of all training rows, summed in the cluster; the driver gets tables of bounded size."""
    shared = ready.sparkSession.sparkContext.broadcast((code, wide))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*shared.value)
        flat = np.zeros(counts.size, np.uint32)
        for batch in batches:
            for g, _, _ in groups(batch, counts.code.size, True):
                counts.add(g, flat)
        for at in range(0, len(flat), SHARD):
            part = flat[at : at + SHARD]
            if part.any():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([at // SHARD], pa.int32()), "sums": pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())})

    def opened(shard: int, data: bytes, size: int) -> np.ndarray:
        n = min(SHARD, size - shard * SHARD)
        return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint32)

    size = Counts(code, wide).size

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[shard] = sums.get(shard, 0) + opened(shard, data, size).astype(np.uint64)
        for shard, total in sums.items():
            total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "sums": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    got = ready.mapInArrow(run, "shard int, sums binary").repartition("shard").mapInArrow(add, "shard int, sums binary").toArrow()
    flat = np.zeros(size, np.uint32)
    for shard, data in zip(got.column("shard").to_pylist(), got.column("sums").to_pylist(), strict=True):
        part = opened(shard, data, size)
        flat[shard * SHARD : shard * SHARD + len(part)] = part
    return Model.of(code, wide, flat)


def train(ready: DataFrame, model: Model) -> Model:
    """The model with weights and last table learnt from all of ready's training rows."""
    shared = ready.sparkSession.sparkContext.broadcast(model)
    size = GATES * N

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own, curve = shared.value, Model.__new__(Model), np.full((GATES, N), 20.0)
        own.__dict__.update(m.__dict__, w=m.w.copy(), cells=m.cells.copy())
        for batch in batches:
            for g, _, _ in groups(batch, own.code.size, True):
                own.learn(g, curve)
        share = curve - 20.0
        values = np.concatenate(((own.w * share).ravel(), share.ravel(), own.cells.ravel()))
        on = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(values[on])], names=["at", "x"])

    got = ready.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    values = np.zeros(2 * size + GATES * CELLS)
    values[got.column("at").to_numpy()] = got.column("x").to_numpy()
    weight, share = values[:size].reshape(GATES, N), values[size : 2 * size].reshape(GATES, N)
    model.w = np.where(share > 0, weight / np.maximum(share, 1e-9), 0.3)
    model.cells = values[2 * size :]
    return model


class Texts:
    """Texts of a block side by side: their words' numbers, each text with an end, which has the last number."""

    def __init__(self, numbers: list[np.ndarray], hashes: np.ndarray):
        end = len(hashes)
        sizes = np.array([len(x) + 1 for x in numbers], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts, self.n = self.ends - sizes, int(sizes.sum())
        self.words = np.full(self.n, end, np.int32)
        inner = np.ones(self.n, bool)
        inner[self.ends - 1] = False
        self.words[inner] = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        self.doc = np.repeat(np.arange(len(numbers), dtype=np.int32), sizes)
        self.place = (np.arange(self.n) - np.repeat(self.starts, sizes)).astype(np.int32)
        self.hashes = np.append(hashes, np.uint64(END_HASH))[self.words]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors and their keys: hashes of the BEFORE tokens of the same text before each."""
        if self.n <= BEFORE:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = self.hashes
        key = _mix(h[: self.n - BEFORE])
        for k in range(1, BEFORE):
            key = _mix(key + h[k : self.n - BEFORE + k])
        on = np.flatnonzero((key % np.uint64(ANCHOR) == 0) & (self.place[BEFORE:] >= BEFORE))
        return on + BEFORE, key[on]

    def following(self, at: np.ndarray) -> np.ndarray:
        """[anchor, NEXT]: short hashes of what follows in the text; zero after its end."""
        padded = np.concatenate((short(self.hashes), np.zeros(NEXT, np.uint32)))
        after = np.lib.stride_tricks.sliding_window_view(padded, NEXT)[at]
        left = self.ends[self.doc[at]] - at
        return np.where(np.arange(NEXT) < left[:, None], after, np.uint32(0))

    def after_last(self) -> np.ndarray:
        """For each token the place of the token after the last earlier pair of its text like the two before it; -1 for none."""
        out = np.full(self.n, -1, np.int32)
        on = np.flatnonzero(self.place >= 2).astype(np.int32)
        w, doc = self.words.astype(np.uint64), self.doc[on].astype(np.uint64)
        pair = _mix(_mix(doc * _G + w[on - 1]) + w[on - 2])
        order = ordered(pair)
        like = pair[order[1:]] == pair[order[:-1]]
        out[on[order[1:][like]]] = on[order[:-1][like]]
        return out


def ordered(values: np.ndarray) -> np.ndarray:
    """The same as a stable argsort of 64-bit hashes: their high bits are sorted with their places in one number."""
    low = np.uint64(max(1, len(values) - 1).bit_length())
    packed = values >> low << low | np.arange(len(values), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    # Different hashes with the same high bits are few; their places are put in order by themselves.
    high, inner = packed >> low, values[order]
    like = high[1:] == high[:-1]
    torn = high[1:][like & (inner[1:] != inner[:-1])]
    if len(torn):
        at = np.searchsorted(high, np.unique(torn), side="left"), np.searchsorted(high, np.unique(torn), side="right")
        for a, b in zip(*at, strict=True):
            order[a:b] = order[a:b][np.argsort(inner[a:b], kind="stable")]
    return order


def leading(key: np.ndarray, doc: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, each once; for each its first training anchor, and the first of another text (-1: none)."""
    order = np.lexsort((doc, ~train, key))
    keys, start = np.unique(key[order], return_index=True)
    group = np.repeat(np.arange(len(keys)), np.diff(np.append(start, len(order))))
    first = order[start]
    other = np.flatnonzero(train[order] & (doc[order] != doc[first][group]))
    second = np.full(len(keys), -1)
    at, place = np.unique(group[other], return_index=True)
    second[at] = order[other[place]]
    return keys, np.where(train[first], first, -1), second


def _sliced(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values' bytes in rows that have these bounds."""
    offsets = (bounds * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _rows_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of a table of bytes, by place; null at -1."""
    width = int(np.prod(data.shape[1:]))
    sizes = np.where(at >= 0, width, 0)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    body = pa.py_buffer(np.ascontiguousarray(data[at[at >= 0]]).tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [pa.array(at >= 0).buffers()[1], pa.py_buffer(offsets.tobytes()), body])


BLOCKS = "kind int, block long, at int, doc_id long, held_out boolean, n_bytes long, tokens binary, word binary, n_train long, key long, next binary"


class Block:
    """Texts of one task that share a vocabulary: their words as numbers."""

    def __init__(self, number: int):
        # A word's number is how many were there before it.
        self.number, self.size, self.words = number, 0, defaultdict(itertools.count().__next__)
        self.train = np.zeros(1 << 16, np.int64)
        self.texts: list[np.ndarray] = []
        self.held: list[bool] = []

    def add(self, texts: pa.Array, held: list[bool]) -> list[np.ndarray]:
        """The numbers of each text's words."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, sizes = split.flatten(), pc.list_value_length(split).to_numpy()
        # White space at a text's ends leaves empty words there.
        whole = pc.binary_length(words).to_numpy() > 0
        if not whole.all():
            words, sizes = words.filter(pa.array(whole)), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[whole], minlength=len(sizes))
        encoded, own = words.dictionary_encode(), self.words
        numbers = np.fromiter(map(own.__getitem__, encoded.dictionary.cast(pa.binary()).to_pylist()), "<i4", len(encoded.dictionary))
        numbers = numbers[encoded.indices.to_numpy()]
        if len(own) > len(self.train):
            self.train = np.concatenate((self.train, np.zeros(len(own), np.int64)))
        learnt = numbers[np.repeat(~np.array(held, bool), sizes)]
        self.train[: len(own)] += np.bincount(learnt, minlength=len(own))
        made = np.split(numbers, np.cumsum(sizes)[:-1])
        self.texts += made
        self.held += held
        return made


def blocks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Rows of three kinds: 0, a document with its words as numbers; 1, a word of the block; 2, an anchor's key.

    A key has one row for each block, with what follows its first training anchor there, if any.
    """
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(n: int, **columns: list | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def ended(block: Block) -> Iterator[pa.RecordBatch]:
        words = list(block.words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(SEED)), np.uint64, len(words))
        for a in range(0, len(words), 50_000):
            some = words[a : a + 50_000]
            n = len(some)
            yield batch_of(n, kind=np.full(n, 1), block=np.full(n, block.number), at=np.arange(a, a + n, dtype=np.int32), word=some, n_train=block.train[a : a + n])
        texts = Texts(block.texts, hashes)
        at, key = texts.anchors()
        if len(at):
            after, train = texts.following(at), ~np.array(block.held, bool)
            keys, first, _ = leading(key, texts.doc[at], train[texts.doc[at]])
            data = np.ascontiguousarray(after.astype("<u4")).view(np.uint8).reshape(len(after), NEXT, 4)[:, :, :3]
            for a in range(0, len(keys), 50_000):
                some = first[a : a + 50_000]
                n = len(some)
                yield batch_of(n, kind=np.full(n, 2), block=np.full(n, block.number), key=keys[a : a + n].view(np.int64), next=_rows_of(data, some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(TaskContext.get().partitionId() << 24)
        for batch in batches:
            ids, held = (batch.column(k).to_pylist() for k in range(2))
            texts = pc.fill_null(batch.column(2), "")
            sizes, at = pc.binary_length(texts).to_pylist(), 0
            while at < len(ids):
                start, first = at, len(block.texts)
                while at < len(ids) and block.size < TEXT_IN_BLOCK and first + at - start < DOCS_IN_BLOCK:
                    block.size += sizes[at]
                    at += 1
                tokens = [x.tobytes() for x in block.add(texts.slice(start, at - start), held[start:at])]
                n = at - start
                yield batch_of(n, kind=np.full(n, 0), block=np.full(n, block.number), at=np.arange(first, first + n, dtype=np.int32), doc_id=ids[start:at], held_out=held[start:at], n_bytes=sizes[start:at], tokens=tokens)
                if block.size >= TEXT_IN_BLOCK or len(block.texts) >= DOCS_IN_BLOCK:
                    yield from ended(block)
                    block = Block(block.number + 1)
        yield from ended(block)
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, BLOCKS)


def answers(keys: DataFrame) -> DataFrame:
    """keys (key, block, next): for each block that another one's training anchor has the key of: (block, key, next).

    A key's first block gets what the second has, all others what the first has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = held = None  # the key, and its first row (block, next)
        served = True
        for batch in batches:
            key, out = batch.column(0).to_numpy(), ([], [], [])
            more = np.concatenate((key[1:] == key[:-1], [True])) if len(key) else np.empty(0, bool)
            like = np.concatenate(([True], more[:-1])) if len(key) else more
            for k in np.flatnonzero(more | like):
                block, after = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                if key[k] != now:
                    now, held, served = key[k], (block, after), False
                    continue
                # Rows without what follows come last, so the first row of a key has it or none has.
                if held[1] is None:
                    continue
                answer = [(block, held[1])]
                if not served and after is not None:
                    answer.append((held[0], after))
                    served = True
                for b, x in answer:
                    out[0].append(b)
                    out[1].append(now)
                    out[2].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["block", "key", "next"])

    dealt = keys.select("key", "block", "next").repartition("key").sortWithinPartitions("key", F.col("next").isNull(), "block")
    return dealt.mapInArrow(run, "block long, key long, next binary")


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """SCORES of docs (doc_id, text); rows where held_out isn't true are learnt from."""
    spark = docs.sparkSession
    held_out = F.coalesce(held_out, F.lit(False))
    ends = docs.filter(~held_out).count()
    rows = stored(blocks(docs, held_out), "blocks", partition_by="kind")
    texts, vocabulary, keys = (rows.filter(f"kind = {k}") for k in range(3))
    matched = stored(answers(keys), "answers")
    for k, part in enumerate((texts, vocabulary, keys)):
        part.stored_at = f"{rows.stored_at}/kind={k}"
    discard(keys)
    words = stored(vocabulary.groupBy("word").agg(F.sum("n_train").alias("c")), "words")
    # VOCABULARY words of LONGEST bytes at most, so they may go to the driver and to every task.
    head = words.filter((F.col("c") > 0) & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(VOCABULARY).toArrow()
    top = spark.createDataFrame(pa.table({"word": head.column("word"), "c": head.column("c"), "id": pa.array(np.arange(head.num_rows, dtype=np.int32))})) if head.num_rows else spark.createDataFrame([], "word binary, c long, id int")
    facts = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    total, distinct = (facts[0] or 0) + ends, facts[1] + (ends > 0)
    tail = words.join(F.broadcast(top.select("word")), "word", "left_anti")
    others, once = (x or 0 for x in tail.agg(F.sum("c"), F.count_if(F.col("c") == 1)).first())
    novel = min(max(once / others, 1 / (others + 1)), others / (others + 1)) if others else 1.0
    end, escape = head.num_rows, head.num_rows + 1
    code = Code([*head.column("c").to_pylist(), ends + 1, others + 1])
    known = words.filter("c > 0").select("word")
    byte_counts = spelling.context_counts(known)
    speller = spelling.train_mixer(known, byte_counts)
    of_bytes = spark.sparkContext.broadcast((byte_counts, speller.w, speller.cells))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, w, cells = of_bytes.value
        mixer, odds = spelling.Mixer(w, cells), []
        for batch in batches:
            odds = odds or [spelling.LogOdds(counts, out) for out in (False, True)]
            for a in range(0, batch.num_rows, spelling.WORDS_IN_BLOCK):
                some = batch.slice(a, spelling.WORDS_IN_BLOCK)
                own, was = some.column(0).to_pylist(), some.column(1).to_numpy() > 0
                lp = np.zeros(len(own))
                for out in (False, True):
                    lp[was == out] = mixer.log10([x for x, y in zip(own, was, strict=True) if y == out], odds[out])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(lp)], names=["word", "c", "lp"])

    # A word that was seen twice is never without a count.
    scored = tail.filter("c < 2").select("word", "c").mapInArrow(spell, "word binary, c long, lp double")
    scored = scored.unionByName(tail.filter("c >= 2").select("word", "c", F.lit(0.0).alias("lp")))
    facts_of = ["block", "at", "c", F.xxhash64("word").alias("hash")]
    common = vocabulary.join(F.broadcast(top), "word").select(*facts_of, "id", F.lit(0.0).cast("float").alias("lp"))
    rare = vocabulary.join(F.broadcast(top.select("word")), "word", "left_anti").join(scored, "word")
    known_words = stored(common.unionByName(rare.select(*facts_of, F.lit(escape).alias("id"), F.col("lp").cast("float").alias("lp"))), "known")
    discard(vocabulary, words)
    # Short hashes of the words with a code, for what followers foretell.
    hashes = short(np.array([*map(word_hash, head.column("word").to_pylist()), END_HASH], np.uint64))
    order = np.argsort(hashes, kind="stable")
    known_hashes, known_ids = hashes[order], order.astype(np.uint16)

    def gather(own: pa.Table, other: pa.Table) -> pa.Table:
        kind = other.column("at").is_valid().to_numpy()
        hash_of, more = other.column("hash").to_numpy().view(np.uint64), np.flatnonzero(~kind)
        place = other.column("at").filter(pa.array(kind)).to_numpy()
        c, ids, lp, h = (np.zeros(len(place) + 1, t) for t in (np.float64, np.int32, np.float64, np.uint64))
        for to, name in ((c, "c"), (ids, "id"), (lp, "lp")):
            to[place] = other.column(name).filter(pa.array(kind)).to_numpy()
        h[place] = hash_of[kind]
        # The end has the last number.
        c[-1], ids[-1] = ends, end
        own = own.sort_by("place")
        held = np.array(own.column("held_out").to_pylist(), bool)
        texts = Texts([np.frombuffer(x, "<i4") for x in own.column("tokens").to_pylist()], h[:-1])
        words, sym = texts.words, ids[texts.words]
        told = texts.after_last()
        one = np.where(told >= 0, sym[told], np.int32(NOTHING))
        one[(one == escape) & (words[told] == words)] = SAME
        # What follows an anchor elsewhere: in another block, else in another text of this one.
        at, key = texts.anchors()
        given = np.frombuffer(b"".join(other.column("next").take(pa.array(more)).to_pylist()), np.uint8).reshape(-1, NEXT, 3).astype(np.uint32)
        given = given[:, :, 0] | given[:, :, 1] << 8 | given[:, :, 2] << 16
        after, source = np.concatenate((texts.following(at), given)), np.full(len(at), -1)
        if len(at):
            doc = texts.doc[at]
            local, first, second = leading(key, doc, ~held[doc])
            k = np.searchsorted(local, key)
            source = np.where((first[k] >= 0) & (doc[first[k]] != doc), first[k], second[k])
        if len(at) and len(more):
            order = np.argsort(hash_of[more])
            keys = hash_of[more][order]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            source = np.where(keys[k] == key, len(at) + order[k], source)
        at, source = at[source >= 0], source[source >= 0]
        del told
        last = np.full(texts.n, -1, np.int32)
        last[at] = np.arange(len(at), dtype=np.int32)
        np.maximum.accumulate(last, out=last)
        follows = np.full(texts.n, NOTHING, np.int32)
        live = np.flatnonzero(last >= 0)
        begun = at[last[live]]
        live = live[(live - begun < NEXT) & (texts.doc[begun] == texts.doc[live])]
        if len(live):
            guess = after[source[last[live]], live - at[last[live]]]
            k = np.minimum(np.searchsorted(known_hashes, guess), len(known_hashes) - 1)
            named = np.where(known_hashes[k] == guess, known_ids[k], escape)
            named = np.where(guess == short(texts.hashes[live]), np.where(sym[live] == escape, SAME, sym[live]), named)
            follows[live] = np.where(guess == 0, NOTHING, named)
        on = np.flatnonzero(sym == escape)
        seen = np.maximum(c[words[on]] - ~held[texts.doc[on]], 0)
        unseen = novel * 10.0 ** np.maximum(lp[words[on]], -290)
        rest = np.log10(np.where(seen > 0, (1 - novel) * seen / max(others, 1), unseen))
        base = np.add.reduceat(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))[words], texts.starts) if len(held) else np.empty(0)
        known = np.add.reduceat((c > 0)[words].astype(np.int64), texts.starts) if len(held) else np.empty(0, np.int64)
        bounds = np.concatenate(([0], texts.ends))
        arrays = [own.column(k) for k in ("doc_id", "held_out", "n_bytes")]
        arrays += [pa.array(np.diff(bounds)), pa.array(known), pa.array(base)]
        arrays += [_sliced(x.astype("<u2"), bounds) for x in (sym, one, follows)]
        arrays.append(_sliced(rest.astype("<f4"), np.searchsorted(on, bounds)))
        return pa.table(arrays, names=[x.split()[0] for x in READY.split(", ")])

    parts = texts.select(F.col("block").alias("part"), F.col("at").alias("place"), "doc_id", "held_out", "n_bytes", "tokens")
    none = lambda kind: F.lit(None).cast(kind)
    said = known_words.select("block", "at", "c", "hash", "id", "lp", none("binary").alias("next"))
    said = said.unionByName(matched.select("block", none("int").alias("at"), none("long").alias("c"), F.col("key").alias("hash"), none("int").alias("id"), none("float").alias("lp"), "next"))
    ready = stored(parts.groupBy("part").cogroup(said.groupBy("block")).applyInArrow(gather, READY), "ready")
    discard(texts, matched, known_words)
    model = train(ready, count(ready, code, widths(total)))
    shared = spark.sparkContext.broadcast(model)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, going_on = np.zeros(batch.num_rows), None
        for g, rest, pieces in groups(batch, shared.value.code.size, False):
            got, left = shared.value.log10(g, rest, going_on if pieces[0][1] else None)
            np.add.at(scores, [r for r, _, _ in pieces], got)
            going_on = left
        bits = -scores / math.log10(2) / (batch.column(2).to_numpy() + 1)
        arrays = [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(np.full(batch.num_rows, total)), batch.column(5), pa.array(scores), pa.array(bits)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCORES.split(", ")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's held-out texts, which are few, come last, as they need other log odds.
        later = []
        for batch in batches:
            held = batch.column(1)
            later.append(batch.filter(held))
            yield scored(batch.filter(pc.invert(held)))
        for batch in later:
            yield scored(batch)

    return ready.mapInArrow(score, SCORES)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learnt from nine folds of ten, scored for every whole text."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fold("doc_id", 10) == 0)
