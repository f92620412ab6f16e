"""Operator 8: hierarchical packing of documents into windows of several context sizes.

A document's ids (and its end id) are cut into whole windows of the longest tier; what remains
goes to the smallest tier that holds it. Tiers are packed from the longest: a remainder opens a
window of its tier, and the gap takes the longest remainders of the shorter tiers that fit; the
last bit of gap takes the head of a document from the shortest tier, whose rest goes on. What is
left at the end of a task's rows is cut at powers of two. So windows have no padding at all: each
is full, or a power of two long. Windows of a tier form step groups of equally many tokens.

Each task packs its own rows, a block at a time, so there is no shuffle and no state beyond the
block. A null text is an empty one (it still has the end id); a null doc_id stays null. Repeated
rows are documents of their own; very long texts are cut into whole windows; of pieces of one length
the later document's goes first. An empty table gives no pieces; other columns play no part.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import by_bytes, prepare
from cloakframe.llm.tokens import encoder

TIERS = (2048, 1024, 512, 256)
#: Tokens in each step group of a tier.
STEP_TOKENS = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows (tier, [(document, start, length)]) for documents of these lengths.

    Pieces that don't fill a window come back as a second list, or with last are cut at powers of two.
    """
    longest, windows = tiers[0], []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        windows += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort()
    total = sum(x[0] for x in pool)
    left: list[tuple[int, int, int]] = []
    for size, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while pool and below < pool[-1][0] <= size <= total:
            n, doc, start = pool.pop()
            window, gap = [(doc, start, n)], size - n
            while gap:
                k = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if k >= 0:
                    n, doc, start = pool.pop(k)
                    window.append((doc, start, n))
                    gap -= n
                else:  # only longer ones are there: the shortest gives its head
                    n, doc, start = pool.pop(0)
                    window.append((doc, start, gap))
                    insort(pool, (n - gap, doc, start + gap))
                    gap = 0
            windows.append((size, window))
            total -= size
    left = [(doc, start, n) for n, doc, start in pool]
    if not last:
        return windows, left
    while left:
        have = sum(n for _, _, n in left)
        size = min(longest, 1 << (have.bit_length() - 1))
        window, gap = [], size
        while gap:
            doc, start, n = left.pop()
            take = min(n, gap)
            window.append((doc, start, take))
            if n > take:
                left.append((doc, start + take, n - take))
            gap -= take
        windows.append((size, window))
    return windows, []


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """A row for each piece of docs (doc_id, text): where it comes from and where it stands.

    sequence_id and step_group have the task's number above their low 32 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId() << 32, encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        seen: dict[int, int] = {}
        sequence = 0

        def emit(block: list[tuple[int | None, int, int, bytes]], windows: list) -> pa.RecordBatch | None:
            nonlocal sequence
            rows: list[tuple] = []
            for tier, window in windows:
                k = seen[tier] = seen.get(tier, -1) + 1
                # The tier's number stands above the group's, so no two tiers share a group.
                group = part + (tier.bit_length() << 26) + k * tier // STEP_TOKENS
                at = 0
                for i, start, n in window:
                    doc, base, total, ids = block[i]
                    rows.append((doc, base + start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), total, part + sequence, at, tier, group))
                    at += n
                sequence += 1
            if not rows:
                return None
            kinds = (pa.int64(),) * 7 + (pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

        rest: list[tuple[int | None, int, int, bytes]] = []  # doc_id, ids before, document's ids, own ids
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts, 4 << 20):
                block = rest + [(d, 0, len(x) // 4 + 1, x + end) for d, x in zip(keys[a:b], encode(texts[a:b]), strict=True)]
                windows, left = pack([len(x[3]) // 4 for x in block], tiers, last=False)
                if out := emit(block, windows):
                    yield out
                rest = [(block[i][0], block[i][1] + s, block[i][2], block[i][3][4 * s : 4 * (s + n)]) for i, s, n in left]
        if rest and (out := emit(rest, pack([len(x[3]) // 4 for x in rest], tiers)[0])):
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op8_tier_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Contract query: every document packed into sequences of at most 2048 ids."""
    import public_tokenizers

    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer or os.path.abspath(public_tokenizers.path("word_bpe_49k.json")))
