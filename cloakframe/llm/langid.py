"""Operator 1: language by segmentation-marginalised unigrams.

The pieces are those of a public byte-level vocabulary; each language has a probability for each
piece. A word's probability is the sum over all its segmentations into pieces, by a forward pass
over its bytes, however long it is; a text's is the product over its words. Words are runs of
letters, in lower case, with a space before them; digits, marks and other signs between them are
read but aren't evidence. Words repeat, so a worker keeps their scores.

The probabilities are fitted by expectation-maximisation: the forward and backward sums of each
word of the training rows give expected counts of pieces, which are added up over all tasks, one
number for each language and piece. Counts are smoothed by the distribution over all languages.

Training rows: rows with a language, a hash of whose doc_id lies below a bound that keeps about
TRAIN_ROWS of each language (all rows of a language that has fewer), for the LANGUAGES commonest
values of lang. That is the documented sample; prediction reads every whole text. A null text, or
one without a letter, is `und` with score 0, and so is every text if there are no training rows.
Ties go to the first language by name. Repeated rows are predicted each; an empty table gives an
empty one. Columns that have the names of the results are replaced; others stay.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cloakframe.llm.common import by_bytes, discard, fold, prepare, stored, unused

#: Training rows of a language, in expectation, and languages that are learnt.
TRAIN_ROWS = 1500
LANGUAGES = 256
ROUNDS = 2
#: Bytes of a word that are worked on at once; longer ones carry their sums over.
CHUNK = 512
#: Weight of the distribution over all languages, in expected pieces.
SMOOTHING = 200.0
KEEP = 400_000
WORDS = re.compile(r"[^\W\d_]+").findall

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20
#: Up to this length sums can't overflow that are relative to those of the byte before.
_SAFE = 20


class Pieces:
    """The vocabulary's pieces that words can have, all single bytes among them, by hash."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        self.pieces = [bytes([b]) for b in range(256)] + sorted({p for p in found if len(p) > 1 and self.wordlike(p)})
        self.n, self.longest = len(self.pieces), max(map(len, self.pieces))
        keys = np.array([self.key(p) for p in self.pieces], np.uint64)
        slots = keys >> np.uint64(64 - _SLOTS)
        order = np.argsort(slots, kind="stable")
        # A slot has a run of pieces; runs are short, and are looked through side by side.
        self.keys, self.ids = keys[order], order.astype(np.int32) + 1
        self.start = np.searchsorted(slots[order], np.arange((1 << _SLOTS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.start).max())
        # For each length the first 16 bits of its keys, so that most places need no further look.
        self.maybe = np.zeros((self.longest + 1, 1 << 16), bool)
        self.maybe[[len(p) for p in self.pieces], keys >> np.uint64(48)] = True

    @staticmethod
    def wordlike(piece: bytes) -> bool:
        """Whether it's a space at most and letters, or parts of their bytes."""
        try:
            return WORDS(t := piece.decode().removeprefix(" ")) in ([], [t]) and (t == "" or t[0].isalpha())
        except UnicodeDecodeError:
            return True

    @staticmethod
    def key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h ^ b) + 1) * int(_MULTIPLIER) & (1 << 64) - 1
            h ^= h >> 29
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers (from 1) by key; 0 where there is none."""
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = np.zeros(h.shape, np.int32)
        for k in range(self.deepest):
            live = at + k < end
            if not live.any():
                break
            place = np.where(live, at + k, 0)
            out = np.where(live & (self.keys[place] == h), self.ids[place], out)
        return out

    def lattice(self, words: list[bytes], a: int, b: int) -> np.ndarray:
        """ids[w, i - a - 1, l - 1]: the piece that word w has from byte i - l to byte i, 0 if none, for a < i <= b."""
        most = min(self.longest, b)
        low = max(0, a + 1 - most)
        text = np.zeros((len(words), b - low), np.uint8)
        for k, w in enumerate(words):
            part = w[low:b]
            text[k, : len(part)] = np.frombuffer(part, np.uint8)
        size = np.array([len(w) for w in words])
        ids = np.zeros((len(words), b - a, most), np.int32)
        h = np.zeros(text.shape, np.uint64)
        for length in range(1, min(most, b - low) + 1):
            starts = b - low - length + 1
            h = ((h[:, :starts] ^ text[:, length - 1 :]) + np.uint64(1)) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            skip = max(0, a + 1 - low - length)
            row, at = np.nonzero(self.maybe[length][h[:, skip:] >> np.uint64(48)])
            end = at + skip + low + length
            on = end <= size[row]
            row, at, end = row[on], at[on] + skip, end[on]
            ids[row, end - a - 1, length - 1] = self.find(h[row, at])
        return ids


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def blocks(words: list[bytes]) -> Iterator[tuple[list[int], int]]:
    """Runs of words of similar length: their places and the greatest length."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        upto = at + 1
        while upto < len(order) and upto - at < 4096 and len(words[order[upto]]) <= len(words[order[at]]) + 3 and (upto - at) * len(words[order[upto]]) < 1 << 17:
            upto += 1
        yield order[at:upto], len(words[order[upto - 1]])
        at = upto


def advance(ids: np.ndarray, la: np.ndarray, first: int, p: np.ndarray) -> None:
    """Fills la[w, first + k + 1, language], log sums over all segmentations up to that byte, from ids[w, k]."""
    present = ids.any(axis=0)
    for k in range(ids.shape[1]):
        i, lengths = first + k + 1, np.flatnonzero(present[k]) + 1
        base = la[:, i - 1]
        if len(lengths) and lengths[-1] > _SAFE:
            for length in lengths[lengths > _SAFE]:
                base = np.maximum(base, np.where(ids[:, k, length - 1, None] > 0, la[:, i - length], -np.inf))
        base = np.where(np.isfinite(base), base, 0)
        total = np.zeros(base.shape)
        for length in lengths:
            got = ids[:, k, length - 1]
            total += np.exp(np.minimum(la[:, i - length] - base, 700)) * p[got]
        la[:, i] = base + np.log(total)


def word_scores(words: list[bytes], table: Pieces, p: np.ndarray) -> np.ndarray:
    """log probability of each word (a row) in each language, summed over its segmentations."""
    out = np.empty((len(words), p.shape[1]))
    with np.errstate(divide="ignore"):
        for places, width in blocks(words):
            some, places = [words[k] for k in places], np.array(places)
            end, row, most = np.array([len(w) for w in some]), np.arange(len(some)), min(table.longest, width)
            # Byte i is at i - a + most: of what lies before a chunk only as much as a piece may span is kept.
            la = np.full((len(some), most + 1, p.shape[1]), -np.inf)
            la[:, most] = 0
            for a in range(0, width, CHUNK):
                b = min(a + CHUNK, width)
                la = np.concatenate((la[:, -most - 1 :], np.empty((len(some), b - a, p.shape[1]))), axis=1)
                advance(table.lattice(some, a, b), la, most, p)
                done = (end > a) & (end <= b)
                out[places[done]] = la[row[done], end[done] - a + most]
    return out


def expected(words: list[bytes], weights: np.ndarray, table: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words with these weights, under one language's p."""
    counts = np.zeros(table.n + 1)
    for places, width in blocks(words):
        some, w = [words[k] for k in places], weights[places]
        end, row = np.array([len(x) for x in some]), np.arange(len(some))
        la = np.zeros((len(some), width + 1, 1))
        cuts = range(0, width, CHUNK)
        with np.errstate(divide="ignore"):
            for a in cuts:
                advance(ids := table.lattice(some, a, min(a + CHUNK, width)), la, a, p[:, None])
        la = la[:, :, 0]
        # cut[i]: the probability that a piece ends at byte i, given the word.
        cut = np.zeros((len(some), width + 1))
        cut[row, end] = 1
        for a in reversed(cuts):
            ids = ids if len(cuts) == 1 else table.lattice(some, a, min(a + CHUNK, width))
            present = ids.any(axis=0)
            for k in reversed(range(ids.shape[1])):
                i = a + k + 1
                for length in np.flatnonzero(present[k]) + 1:
                    got = ids[:, k, length - 1]
                    on = np.flatnonzero(got)
                    got = got[on]
                    share = cut[on, i] * p[got] * np.exp(la[on, i - length] - la[on, i])
                    cut[on, i - length] += share
                    np.add.at(counts, got, w[on] * share)
    return counts


def words_of(text: str | None) -> list[str]:
    return WORDS((text or "").lower())


def has_letter(found: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in found)


def spelled(word: str) -> bytes:
    """The space and the word as UTF-8."""
    return b" " + word.encode("utf-8", "surrogatepass")


class Model:
    """Languages and their piece probabilities; row 0 of p stands for no piece."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray):
        self.path, self.langs, self.p = path, langs, p
        self.number: dict[str, int] = {}
        self.scores = np.empty((1 << 12, len(langs)))

    def __reduce__(self):
        return Model, (self.path, self.langs, self.p)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability, all languages being equally likely before."""
        out: list[tuple[str, float]] = []
        if len(self.number) > KEEP:
            self.number.clear()
        cut = [words_of(t) for t in texts]
        new = list(set().union(*cut) - self.number.keys())
        if new and self.langs:
            got = word_scores([spelled(w) for w in new], pieces(self.path), self.p)
            first = len(self.number)
            if first + len(new) > len(self.scores):
                self.scores = np.concatenate((self.scores[:first], np.empty((len(new) + first + 4096, len(self.langs)))))
            self.scores[first : first + len(new)] = got
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
        get = self.number.__getitem__
        for found in cut:
            if not self.langs or not has_letter(found):
                out.append(("und", 0.0))
                continue
            total = self.scores[np.fromiter(map(get, found), np.int64, len(found))].sum(axis=0)
            odds = np.exp(total - total.max())
            k = int(odds.argmax())
            out.append((self.langs[k], float(odds[k] / odds.sum())))
        return out


def train(docs: DataFrame, usable: Column, path: str, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> Model:
    """Fits a model to docs (doc_id, text, lang) where usable holds and lang isn't null.

    The driver gets a row for each of LANGUAGES languages at most, and the sums: vocabulary times languages.
    """
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model(path, [], np.empty((1, 0)))
    # A language that isn't learnt has no share, so its rows aren't in the sample.
    share = F.try_element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, rows / sizes[lang]))]), F.col("lang"))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "lang")
    number = {lang: k for k, lang in enumerate(langs)}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(text):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    words = stored(sample.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    table = pieces(path)
    p = np.full((table.n + 1, len(langs)), 1 / table.n)
    p[0] = 0
    for _ in range(rounds):
        now = p

        def count(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            own, sums = pieces(path), {}
            for batch in batches:
                by_lang: dict[str, tuple[list[bytes], list[int]]] = {}
                for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    some = by_lang.setdefault(lang, ([], []))
                    some[0].append(spelled(word))
                    some[1].append(n)
                for lang, (some, n) in by_lang.items():
                    sums[lang] = sums.get(lang, 0) + expected(some, np.array(n, float), own, now[:, number[lang]])
            for lang, total in sums.items():
                on = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on)), pa.array(on, pa.int32()), pa.array(total[on])], names=["lang", "piece", "n"])

        counts = np.zeros_like(p)
        sums = words.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        column = np.array([number[x] for x in sums.column("lang").to_pylist()], np.int64)
        counts[sums.column("piece").to_numpy(), column] = sums.column("n").to_numpy()
        whole = counts.sum(axis=1) + 1e-3
        whole[0] = 0
        p = counts + SMOOTHING * (whole / whole.sum())[:, None]
        p /= p.sum(axis=0)
    discard(words)
    return Model(path, langs, p)


def vocabulary() -> str:
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score; the text is the only input. Columns so named are replaced."""
    rest = [f for f in docs.schema.fields if f.name not in names]
    schema = StructType([*rest, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    at = [f.name for f in rest].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, got = batch.column(at).to_pylist(), []
            for a, b in by_bytes(texts, 4 << 20):
                got += shared.value.predict(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return docs.select(*[f"`{f.name}`" for f in rest]).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs that have letters and a language with at least this score, as they are."""
    names = unused(docs, "lang"), unused(docs, "score")
    marked = predict(docs, model, names)
    return marked.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).drop(*names)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fitted on two folds, predicted for every whole text."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold("doc_id", 3) == 1
    model = train(docs, ~held_out, vocabulary())
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
