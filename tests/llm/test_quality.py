import random

import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import quality
from cloakframe.llm.quality import STATS, covers, fit, op2_quality, scored, statistics
from helpers import DOCS, ODD, doc

LABELS = "doc_id long, quality int, toxic int"


def made(n):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice("abcdefgh") * rng.randrange(1, 6) for _ in range(rng.randrange(5, 60))]
        rows.append(doc(i, " ".join(x if good else x + "###" for x in w)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_expression_is_the_model(spark):
    rows, labels = made(200)
    x = np.array([statistics(r[1]) for r in rows])
    model = fit(x, np.array([q for _, q, _ in labels], float))
    assert 0 < len(model.rules) < 100 and all(w for _, w in model.rules)
    got = {r.doc_id: r.score for r in scored(spark.createDataFrame(rows, DOCS), model, ["doc_id"]).collect()}
    assert all(abs(got[i] - s) < 1e-12 for i, s in enumerate(model.score(x)))
    rule = model.rules[0][0]
    assert covers(rule, x).any() and all(0 <= k < len(STATS) for k, _, _ in rule)


def test_held_out(spark, tables):
    rows, labels = made(300)
    extra = [(2000 + i, *r[1:]) for i, r in enumerate(ODD)] + [(None, "no id", "en", None, None, None)]
    d = tables(documents=(rows + extra, DOCS), labels=([*labels, (1, None, None), (None, 1, 0), labels[0], (5000, 1, 1)], LABELS))
    got = {r.doc_id: r for r in op2_quality(spark, d).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert len(held) > 60 and sum(p == q for p, q in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_no_labels(spark, tables):
    rows, labels = made(20)
    assert {r.score for r in op2_quality(spark, tables(documents=(rows, DOCS), labels=([], LABELS))).collect()} == {0.5}
    one = [(i, 1, 0) for i, _, _ in labels]
    scores = {r.score for r in op2_quality(spark, tables(documents=(rows, DOCS), labels=(one, LABELS))).collect()}
    assert len(scores) == 1 and scores.pop() > 0.5
    assert op2_quality(spark, tables(documents=([], DOCS), labels=(one, LABELS))).collect() == []


def test_an_id_with_many_rows(spark, monkeypatch):
    """Neither rows nor labels that repeat reach the driver beyond the bound."""
    rows, labels = made(60)
    many = [(labels[0][0], *r[1:]) for r in rows[:1] * 400]
    docs = spark.createDataFrame(rows + many, DOCS)
    taken = []
    monkeypatch.setattr(quality, "fit", lambda x, y: taken.append(len(y)))
    quality.train(docs, spark.createDataFrame(labels + labels[:1] * 300, LABELS), F.lit(True), rows=20)
    assert 0 < taken[0] <= quality.SPARE * 20
