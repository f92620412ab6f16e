"""Operator 9: benchmark items in documents, up to a few edits.

Text is compared in lower case with each run of white space as one space. An item of n characters
may have k = n * ERROR_RATE edits (insertions, deletions, substitutions of a character). Cut into
k + 1 pieces, an occurrence within the budget has one piece unchanged at least; so all items'
pieces are looked for at once by an Aho-Corasick automaton, and the surroundings of each hit are
checked by Myers' bit-parallel distance. Nothing within the budget is missed. An item so short that
its budget is zero must stand as whole words: next to its ends there is no letter or digit that
would go on with the item's own (so `cat` isn't found in `category`).

Items go to all tasks in blocks of at most BLOCK_CHARS characters, one pass over the documents
each. Null and empty items match nothing; neither do null texts, which hold nothing. Items that
repeat are each reported, an item without an id too. Of equally good occurrences the first counts.
Very long texts are searched whole. Repeated rows are each searched; an empty table of documents
gives an empty one, and without items no text holds any. A column that has the name of the result
is replaced; others stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from cloakframe.llm.common import prepare

ERROR_RATE = 0.05
BLOCK_CHARS = 16 << 20
LEAK = StructType([StructField(n, LongType()) for n in ("item_id", "distance", "item_chars", "start", "end")])


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float = ERROR_RATE) -> int:
    return int(n * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 runs of about equal length, with their places."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edits between the pattern and a substring of text (of a prefix, if anchored), and its end.

    Of equal ends the first counts.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end, get = full, 0, m, m, 0, masks.get
    for at, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, at
        ph = ph << 1 | anchored
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


def whole(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] neither begins nor ends within a run of letters and digits."""
    cut = lambda k: 0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum()
    return not cut(start) and not cut(end)


class Matcher:
    """Finds items (item_id, plain text) in plain texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = ERROR_RATE):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[dict[str, int]]:
        """The best occurrence of each item within its budget; of equally good ones the first."""
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = {}
        exact: dict[int, int] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, at in places:
                if self.items[n][2]:
                    starts.setdefault(n, set()).add(last + 1 - size - at)
                elif n not in exact and whole(text, last + 1 - size, last + 1):
                    exact[n] = last + 1 - size
        out = []
        for n in sorted(starts.keys() | exact.keys()):
            item_id, item, k = self.items[n]
            got = (0, exact[n], exact[n] + len(item)) if n in exact else self._best(n, item, k, sorted(starts[n]), text)
            if got:
                out.append({"item_id": item_id, "distance": got[0], "item_chars": len(item), "start": got[1], "end": got[2]})
        return out

    def _best(self, n: int, item: str, k: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        for s in starts:
            if s >= 0 and text.startswith(item, s):
                return 0, s, s + len(item)
        masks = self.masks.setdefault(n, masks_of(item))
        best, at = None, 0
        while at < len(starts):
            # Occurrences of neighbouring hits share a window.
            a = max(0, starts[at] - k)
            b = starts[at] + len(item) + k
            while at + 1 < len(starts) and starts[at + 1] - k <= b:
                at += 1
                b = starts[at] + len(item) + k
            at += 1
            window = text[a:b]
            distance, end = myers(masks, len(item), window)
            if distance <= k and (best is None or distance < best[0]):
                back = window[max(0, end - len(item) - k) : end][::-1]
                _, size = myers(masks_of(item[::-1]), len(item), back, anchored=True)
                best = distance, a + end - size, a + end
        return best


_MATCHERS: dict[str, Matcher] = {}


def with_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, column: str = "leaks") -> DataFrame:
    """docs with an array of the items found in each text; a column of that name is replaced."""
    spark = docs.sparkSession
    rest = [f for f in docs.schema.fields if f.name != column]
    at = [f.name for f in rest].index("text")
    leaks = ArrayType(LEAK)
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in LEAK.fields]))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    out = docs.select(*[f"`{f.name}`" for f in rest])
    for block in range(blocks):
        # A block has BLOCK_CHARS characters, give or take the longest item.
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        texts = sorted(((r.item_id, t) for r in own.collect() if (t := plain(r.text))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        shared = spark.sparkContext.broadcast((f"{spark.sparkContext.applicationId}/{id(texts)}/{block}/{hash(tuple(texts))}", texts, rate))
        width = len(rest)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            name, texts, rate = shared.value
            if name not in _MATCHERS:
                _MATCHERS.clear()
                _MATCHERS[name] = Matcher(texts, rate)
            find = _MATCHERS[name].find
            for batch in batches:
                found = [find(plain(t)) for t in batch.column(at).to_pylist()]
                if batch.num_columns > width:
                    found = [a + b for a, b in zip(batch.column(width).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, kind)], names=[*(f.name for f in rest), column])

        out = out.mapInArrow(run, StructType([*rest, StructField(column, leaks)]))
    return out


def op9_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds within the error budget."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
