"""Operator 2: quality by a sparse rule ensemble.

Each text gives a few statistics. Shallow trees are grown on labelled rows; every path from a
root to a node is a rule, a conjunction of bounds on statistics. A logistic regression with a
lasso penalty keeps few of them, and the kept rules with their weights become one Spark column
expression over the statistics, so scoring is plain SQL once the statistics are there.

Training rows: labelled rows with a quality of 0 or 1, a hash of whose doc_id lies below a bound
that keeps about TRAIN_ROWS of them; only their statistics reach the driver. That is the
documented sample; scoring reads every whole text. A document with several labels counts once for
each. If only one label occurs, or none, the score is the same for all texts (0.5 for none).
Where ids repeat so often that there are over SPARE times as many, the first by a hash are taken.
A null text is an empty one; its statistics are zero. Very long texts are read whole, repeated rows
scored each; a score of exactly 0.5 is a 1. Empty tables give empty ones. Columns that have the
names of the results are replaced; others stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cloakframe.llm.common import fold, prepare, unused

#: Labelled rows that the trees and weights are fitted on, in expectation.
TRAIN_ROWS = 4_000
#: Rows that reach the driver, at most, over the rows that are expected to.
SPARE = 4
TREES = 16
DEPTH = 3
BINS = 24
#: Penalties that are tried; of those whose loss on every fifth row is within SLACK of the least, the
#: largest is taken, which keeps the fewest rules.
PENALTIES = (0.03, 0.01, 0.003, 0.001)
SLACK = 0.01

STATS = ("n_words", "n_lines", "word_length", "line_words", "upper", "digits", "marks", "rare_marks", "high_bytes", "distinct_words", "distinct_lines", "top_word", "bare_words", "short_words", "marked_ends", "copied_tail")
_CLASS = np.zeros((5, 256))
_CLASS[0, ord("A") : ord("Z") + 1] = 1
_CLASS[1, ord("0") : ord("9") + 1] = 1
_CLASS[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1
_CLASS[3, [ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\!"]] = 1
_CLASS[4, 128:] = 1


def statistics(text: str | None) -> list[float]:
    """The text's STATS; all are finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = (text or "").split(), [x for x in (text or "").split("\n") if x]
    if not words:
        return [0.0] * len(STATS)
    n = len(words)
    shares = _CLASS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    counts = Counter(words)
    ends = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,"))
    bare = sum(1 for w in words if not (w[0].isalpha() or w[0].isdigit()))
    half = n // 2
    return [
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        sum(map(len, words)) / n,
        n / len(lines) if lines else 0.0,
        *shares.tolist(),
        len(counts) / n,
        len(set(lines)) / len(lines) if lines else 0.0,
        max(counts.values()) / n,
        bare / n,
        sum(1 for w in words if len(w) <= 3) / n,
        ends / n,
        len(set(words[:half]) & set(words[half:])) / n,
    ]


def with_statistics(docs: DataFrame, keep: list[str], name: str = "stats") -> DataFrame:
    """docs' columns keep and a struct of the text's statistics for each row, under this name."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = StructType([*fields, StructField(name, StructType([StructField(s, DoubleType()) for s in STATS]))])
    names = [f.name for f in fields]
    at = names.index("text") if "text" in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([statistics(x) for x in batch.column(at).to_pylist()]).reshape(-1, len(STATS))
            stats = pa.StructArray.from_arrays([pa.array(c) for c in got.T], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], stats], names=schema.names)

    columns = [f"`{c}`" for c in names] + [F.col("text").alias("__text")] * (at == len(names))
    return docs.select(*columns).mapInArrow(run, schema)


#: A rule: bounds (statistic, low, high) with low < value <= high.
Rule = tuple[tuple[int, float, float], ...]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> list[Rule]:
    """The rules of one tree on a bootstrap sample, from its root's children down."""
    rows = rng.integers(0, len(y), len(y))
    x, y = x[rows], y[rows]
    found: list[Rule] = []

    def narrowed(rule: Rule, k: int, low: float, high: float) -> Rule:
        bounds = {s: (a, b) for s, a, b in rule}
        a, b = bounds.get(k, (-np.inf, np.inf))
        bounds[k] = (max(a, low), min(b, high))
        return tuple((s, *bounds[s]) for s in sorted(bounds))

    def split(on: np.ndarray, rule: Rule, left: int) -> None:
        if rule:
            found.append(rule)
        if not left or len(on) < 20 or y[on].min() == y[on].max():
            return
        best, cut = 1e-4 * len(y), None
        for k in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
            v = x[on, k]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])):
                below = v <= t
                n = below.sum()
                if n < 5 or len(on) - n < 5:
                    continue
                a, b = y[on][below].mean(), y[on][~below].mean()
                gain = n * (len(on) - n) / len(on) * (a - b) ** 2
                if gain > best:
                    best, cut = gain, (int(k), float(t))
        if cut is None:
            return
        k, t = cut
        below = x[on, k] <= t
        split(on[below], narrowed(rule, k, -np.inf, t), left - 1)
        split(on[~below], narrowed(rule, k, t, np.inf), left - 1)

    split(np.arange(len(y)), (), depth)
    return found


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, k] > a) & (x[:, k] <= b) for k, a, b in rule])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n = len(y)
    rate = 4 * n / max(1.0, np.linalg.norm(np.column_stack((np.ones(n), z)), 2) ** 2)
    w = v = np.zeros(z.shape[1] + 1)
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(v[0] + z @ v[1:], -30, 30)))
        new = v - rate * np.concatenate(([(p - y).mean()], z.T @ (p - y) / n))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1:]


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: np.ndarray) -> np.ndarray:
        total = np.full(len(stats), self.bias)
        for rule, w in self.rules:
            total += w * covers(rule, stats)
        return 1 / (1 + np.exp(-total))

    def column(self, stats: str = "stats") -> Column:
        """The score as a column expression over the struct of statistics."""
        total = F.lit(self.bias)
        for rule, w in self.rules:
            bounds = []
            for k, a, b in rule:
                value = F.col(f"`{stats}`.{STATS[k]}")
                bounds += [value > a] * bool(np.isfinite(a)) + [value <= b] * bool(np.isfinite(b))
            total = total + F.when(reduce(Column.__and__, bounds), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> RuleModel:
    """Trees, rules and weights for statistics x and labels y in {0, 1}."""
    if not len(y) or y.min() == y.max():
        share = 0.5 if not len(y) else (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    rules = list(dict.fromkeys(r for _ in range(TREES) for r in grow(x, y, rng)))
    z = np.column_stack([covers(r, x) for r in rules]).astype(float) if rules else np.empty((len(y), 0))
    # Rules that cover the same rows count once.
    own = {c.tobytes(): k for k, c in reversed(list(enumerate(z.T.astype(bool))))}
    first = sorted(own.values())
    rules, z = [rules[k] for k in first], z[:, first]
    test = np.arange(len(y)) % 5 == 4
    chosen = PENALTIES[-1]
    if len(y) >= 50 and 0 < y[~test].mean() < 1:
        loss = []
        for penalty in PENALTIES:
            bias, w = lasso(z[~test], y[~test], penalty)
            p = np.clip(1 / (1 + np.exp(-(bias + z[test] @ w))), 1e-6, 1 - 1e-6)
            loss.append(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
        chosen = next(c for c, x in zip(PENALTIES, loss, strict=True) if x <= min(loss) + SLACK)
    bias, w = lasso(z, y, chosen)
    return RuleModel(bias, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v])


def train(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TRAIN_ROWS) -> RuleModel:
    """Fits a model to docs (doc_id, text) with labels (doc_id, quality) where usable holds."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(usable)
    n = known.count()
    bound = int(min(1.0, rows / max(n, 1)) * (1 << 20))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound).orderBy(F.xxhash64("doc_id", "quality")).limit(SPARE * rows)
    # The sample's bound is the parameter rows, so it may be sent to all tasks.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = with_statistics(texts, ["doc_id", "quality"]).select("doc_id", "quality", "stats.*")
    got = found.orderBy(F.xxhash64("doc_id", "quality", *STATS)).limit(SPARE * rows).toPandas()
    got = got.iloc[np.lexsort((got["quality"], got["doc_id"] * 0x9E3779B1 % (1 << 32)))] if len(got) else got
    return fit(got[list(STATS)].to_numpy(float), got["quality"].to_numpy(float))


def scored(docs: DataFrame, model: RuleModel, keep: list[str]) -> DataFrame:
    """docs' columns keep, with score and predicted; the text is the only input."""
    stats = with_statistics(docs, [c for c in keep if c not in ("score", "predicted")])
    return stats.withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("stats")


def accepted(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of docs that the model predicts to be good, as they are."""
    name = unused(docs, "stats")
    return with_statistics(docs, docs.columns, name).filter(model.column(name) >= 0.5).drop(name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fitted on two folds, scored for every whole text."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = fold("doc_id", 3) == 1
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "score", "predicted")
