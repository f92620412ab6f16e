import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import near
from cloakframe.llm.simhash import words
from helpers import DOCS, ODD, doc

LABELS = "doc_id long, quality int, toxic int"
BENCH = "item_id long, text string"
ITEM = "a benchmark passage that must not be seen in any training text because it would leak the answer"


def text(rng, n):
    return " ".join(rng.choice("abcdefgh") + "".join(rng.choices("aeioulnrst", k=rng.randrange(2, 8))) for _ in range(n))


def changed(rng, t, n):
    w = t.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = "other" + str(rng.randrange(99))
    return " ".join(w)


def shingles(t):
    w = words(t)
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_sketches():
    rng = random.Random(1)
    for n, edits in ((40, 1), (150, 3), (2000, 40)):
        a = text(rng, n)
        b = changed(rng, a, edits)
        got = near.similarity(near.sketch(words(a)), near.sketch(words(b)))
        assert abs(got - jaccard(a, b)) < (1e-9 if n < 190 else 0.1)
    assert near.similarity(b"", b"") == 1 and near.similarity(b"", near.sketch([b"x"])) == 0


def test_similarity_is_exact_for_long_texts():
    rng = random.Random(7)
    for _ in range(20):
        a = text(rng, 900)
        b = changed(rng, a, 20)
        assert near.similarity(near.sketch(words(a)), near.sketch(words(b))) == jaccard(a, b)


def test_spreads_bound_the_similarity():
    rng = random.Random(6)
    for n in (3, 8, 40, 300, 2000):
        a = text(rng, n)
        for b in (a, changed(rng, a, n // 4), a + " " + text(rng, 3 * n), text(rng, n + 5)):
            x, y = near.sketch(words(a)), near.sketch(words(b))
            assert near.similarity(x, y) - 1e-12 <= near.most_similar(near.spread(x), near.spread(y)) <= 1
    assert near.most_similar(near.spread(near.sketch(words(text(rng, 500)))), near.spread(near.sketch(words(text(rng, 500))))) < 0.6
    assert near.most_similar(b"", near.spread(b"")) == 1


def test_bitmap_has_all_ids(spark):
    ids = [*range(0, 40_000, 7), (3 << 33) + 5, -4]
    frame = spark.createDataFrame([(i, f"a text of number {i}") for i in ids], "id long, text string")
    got = {r.id for r in near.shingle_sets(frame, bytes, frame.filter("id % 2 = 0")).select("id").collect()}
    want = {i for i in ids if i % 2 == 0}
    assert want <= got and len(got) < 1.3 * len(want)
    assert near.shingle_sets(frame, bytes, frame.filter("id = 1")).collect() == []


def test_shared_keys(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(300), i, 9, 0, False) for i in range(300)] + [(1000 + i % 3, i, 9, 0, True) for i in range(50)] + [(5000, 1, 9, 0, True)]
    got = sorted(tuple(r) for r in near.shared(spark.createDataFrame(rows, "key long, id long, n int, at int, common boolean")).collect())
    many = {k for k, *_ in rows if sum(x[0] == k for x in rows) > 1} | {5000}
    assert got == sorted(r for r in rows if r[0] in many)


@pytest.mark.parametrize("common", [False, True])
def test_crowds_in_blocks(spark, monkeypatch, common):
    """Links of a crowd that is cut into blocks join the same texts as all its pairs do."""
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "WHOLE", 5)
    rng = random.Random(12)
    base = text(rng, 120).split()
    made = []
    for _ in range(60):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 9)):
            w[k] = "new" + str(rng.randrange(30))
        made.append(" ".join(w))
    texts = spark.createDataFrame(list(enumerate(made)), "id long, text string")
    n = {i: len(shingles(t)) for i, t in enumerate(made)}
    rows = spark.createDataFrame([(7, i, n[i], 0, common, i) for i in range(60)], "key long, id long, n int, at int, common boolean, root long")
    links = {(r.a, r.b) for r in near.crowd_links(rows, texts, 0.8).collect()}

    def groups(pairs):
        up = list(range(60))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        return up

    true = {(a, b) for a in range(60) for b in range(a + 1, 60) if jaccard(made[a], made[b]) >= 0.8}
    assert links <= true
    same = lambda g: {frozenset(i for i in range(60) if g[i] == x) for x in g}
    assert same(groups(links)) == same(groups(true)) and len(same(groups(true))) > 1


def test_whole_hashes_meet_once_for_many_crowds(spark, monkeypatch):
    rng = random.Random(15)
    base = text(rng, 200)
    made = {i: changed(rng, base, 1) if i < 12 else text(rng, 200) for i in range(16)}
    texts = spark.createDataFrame(list(made.items()), "id long, text string")
    # Each text has ten crowded shingles.
    rows = spark.createDataFrame([(k, k % 2 == 0, i, 196, 0, i) for i in made for k in range(10)], "key long, common boolean, id long, n int, at int, root long")
    met = []
    in_blocks = near.in_blocks
    monkeypatch.setattr(near, "in_blocks", lambda rows, texts, form, *more: met.append((form, rows.count())) or in_blocks(rows, texts, form, *more))
    links = {(r.a, r.b) for r in near.crowd_links(rows, texts, 0.8).collect()}
    assert met[1] == (bytes, 12)
    assert len(links) == 11 and {x for link in links for x in link} == set(range(12))
    assert all(jaccard(made[a], made[b]) >= 0.8 for a, b in links)


def test_one_hot_crowd(spark):
    """Texts that all share a passage, and no more than that, all stay; copies of one text become one row."""
    rng = random.Random(10)
    line = text(rng, 12)
    rows = [doc(i, line + " " + text(rng, 30)) for i in range(120)] + [doc(1000 + i, line + " alike in all") for i in range(300)]
    rows += [doc(2000 + i, line + " " + changed(rng, rows[i][1], 0)[len(line) + 1 :] + " more") for i in range(5)]
    kept = {r.doc_id for r in near.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    close = {2000 + i for i in range(5) if jaccard(rows[i][1], rows[420 + i][1]) >= 0.8}
    assert kept == set(range(120)) | {1000} | {2000 + i for i in range(5)} - close and len(close) == 5


def test_names_and_repeated_rows(spark):
    schema = "doc_id long, text string, sig string, row long, id long, root long, __row long"
    rows = [(None, "a b c", "s", 1, 2, 3, 4), (None, "a b c", "s", 1, 2, 3, 4), (7, "x y z", None, None, None, None, None), (7, "x y z", "t", 9, 9, 9, 9), (8, None, "u", 0, 0, 0, 0), (3, " ", "v", 0, 0, 0, 0)]
    got = near.drop_near_copies(spark.createDataFrame(rows, schema))
    assert got.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == [(0, "a b c"), (3, " "), (7, "x y z")]


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Neither for the texts that are compared nor for the rows that stay, however many ids there are."""
    plans = []
    stored = near.stored
    monkeypatch.setattr(near, "stored", lambda df, name, **more: plans.append((name, df)) or stored(df, name, **more))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k, f"{k // 2} some words of a text and {k // 2} more of them") for k in range(200)], "doc_id long, text string").repartition(7)
        got = near.drop_near_copies(docs)
        plans.append(("out", got))
        assert sorted(r.doc_id for r in got.collect()) == list(range(0, 200, 2))
        for name, df in plans:
            if name != "marked":
                assert not ("text" in df.columns and "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_some_rows(spark):
    rows = spark.range(0, 5000, 1, 5).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("of"), "id").cache()
    want = {r.row for r in rows.collect() if r.id % 7 in (0, 3)}
    ids = near.packed(rows.filter("id % 7 in (0, 3)").select(F.col("row").alias("id")))
    got = near.only(rows, "row", ids)
    assert got.columns == rows.columns and sorted(r.row for r in got.collect()) == sorted(want) and len({r >> 33 for r in want}) == 5
    assert near.only(rows, "row", near.packed(rows.filter("false").select("id"))).count() == 0


def test_near_copies_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(25):
        t = text(rng, rng.choice((60, 250, 800)))
        rows.append(doc(10 * i, t))
        rows.append(doc(10 * i + 1, t.upper().replace(" ", "\n")))
        rows.append(doc(10 * i + 2, changed(rng, t, max(1, len(t.split()) // 100))))
        rows.append(doc(10 * i + 3, changed(rng, t, len(t.split()) // 4)))
    kept = {r.doc_id for r in near.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()}
    texts = {r[0]: r[1] for r in rows}
    close = {k for k in texts if k % 10 == 2 and jaccard(texts[k], texts[k - 2]) >= 0.8}
    assert len(close) > 10
    assert {k for k in texts if k % 10 in (0, 3)} <= kept and not any(k % 10 == 1 for k in kept)
    assert len(kept & close) <= 1 and {k for k in texts if k % 10 == 2} - close <= kept


def test_block_edits(spark):
    """Text appended, cut off or replaced in one block: each pair of 0.8 or more is found, no other."""
    rng = random.Random(8)
    rows, left = [], set()
    for i in range(120):
        w, n = text(rng, 300).split(), rng.randrange(10, 70)
        put = text(rng, n).split()
        other = (w + put, w[:-n], w[:100] + put + w[100 + n :])[i % 3]
        a, b = " ".join(w), " ".join(other)
        rows += [doc(2 * i, a), doc(2 * i + 1, b)]
        left |= {2 * i} if jaccard(a, b) >= 0.8 else {2 * i, 2 * i + 1}
    assert 130 < len(left) < 220
    assert {r.doc_id for r in near.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()} == left


def test_one_base_and_many_edited_copies(spark):
    """Copies that are similar to their base only, whose id is not the least, are one group by it."""
    rng = random.Random(9)
    base = text(rng, 300)
    copies = [changed(rng, base, 5) for _ in range(100)]
    assert all(jaccard(base, c) >= 0.8 for c in copies)
    rows = [doc(i, t) for i, t in enumerate([*copies[:50], base, *copies[50:]])]
    assert [r.doc_id for r in near.drop_near_copies(spark.createDataFrame(rows, DOCS)).collect()] == [0]


def test_stages(spark, tables):
    rng = random.Random(3)
    good = [doc(i, text(rng, rng.randrange(30, 120)), "xx") for i in range(100, 160)]
    junk = [doc(i, " ".join(w + "###" for w in text(rng, 50).split()), "xx") for i in range(200, 240)]
    leak = [doc(300, text(rng, 30) + " " + ITEM + " " + text(rng, 30), "xx")]
    copy = [doc(400, good[0][1], "xx"), doc(99, good[1][1], "xx")]
    rows = good + junk + leak + copy + ODD
    labels = [(r[0], 1, 0) for r in good[:40]] + [(r[0], 0, 0) for r in junk[:30]]
    d = tables(documents=(rows, DOCS), labels=(labels, LABELS), benchmark=([(1, ITEM), (2, None)], BENCH))
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, d), name)
        seen[name] = docs
        if name != "packing":
            assert docs.dtypes == spark.read.parquet(f"{d}/documents.parquet").dtypes
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    clean = {r[0] for r in good}
    assert clean <= ids["quality"] and not ids["quality"] & {r[0] for r in junk}
    assert clean <= ids["language"] and not ids["language"] & {2, 3, 4}
    assert ids["language"] - ids["near_duplicates"] >= {400, good[1][0]} and 99 in ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {300}
    assert ids["packing"] == ids["decontamination"]
    total = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).filter("n <> m").count()
    assert total == 0


def test_empty(spark, tables):
    d = tables(documents=([], DOCS), labels=([], LABELS), benchmark=([], BENCH))
    assert corpus_pipeline.run(spark, d).collect() == []


def test_clashing_names(spark, tables):
    rng = random.Random(5)
    schema = "doc_id long, text string, lang string, score double, stats string, lang_pred string, leaks int, __note string, sig string, row long"
    rows = [(i, text(rng, 40), "xx", 0.5, "s", None, 3, "n", "g", 4) for i in range(12)]
    d = tables(documents=(rows, schema), labels=([(i, i % 2, 0) for i in range(0)], LABELS), benchmark=([(1, ITEM)], BENCH))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, docs.collect())) == rows
