import itertools
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cloakframe.llm.hilbert import hilbert_index, op7_hilbert_shards, op7_sql, run_bounds, shard_runs
from helpers import DOCS, ODD, doc


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_curve_takes_single_steps(spark, n, bits):
    points = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(points, [f"d{i}" for i in range(n)])
    got = {r[-1]: tuple(r)[:-1] for r in df.withColumn("h", hilbert_index([F.col(f"d{i}") for i in range(n)], bits)).collect()}
    assert sorted(got) == list(range(len(points)))
    assert all(sum(abs(a - b) for a, b in zip(got[h], got[h + 1])) == 1 for h in range(len(points) - 1))


def test_query(spark, tables):
    got = op7_hilbert_shards(spark, tables(documents=(ODD, DOCS))).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    text = {r[0]: (r[1] or "").encode() for r in ODD}
    slots = defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min([len(slots[k]) for k in range(8)]) <= 1
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in order)


def test_runs_prune(spark):
    df = spark.range(4096).selectExpr("id", "cast(id % 64 as int) a", "cast(id div 64 as int) b")
    runs = run_bounds(shard_runs(df, [F.col("a") / 2, F.col("b") / 2], "id", 16), ["a", "b"]).collect()
    assert {r.rows for r in runs} == {256}
    assert all(r.max_a - r.min_a < 32 and r.max_b - r.min_b < 32 for r in runs)


def test_names_and_a_key_with_many_rows(spark):
    """A table's own columns stay, whatever their names; rows of one key spread over the shards."""
    names = ["tie", "rank", "total", "part", "before", "within", "seq", "place", "row", "key", "rows"]
    df = spark.range(400).selectExpr("cast(null as long) id", "cast(id as int) n", *[f"'{c}' || id as {c}" for c in names], "5 as slot")
    out = shard_runs(df.repartition(4), [F.lit(1), F.lit(2)], "id", 8)
    assert out.columns == ["id", "n", *names, "hilbert", "shard", "slot"]
    rows = out.collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(8) for i in range(50)]
    assert sorted(r.n for r in rows) == list(range(400)) and all(r[c] == f"{c}{r.n}" for r in rows for c in names)


def test_empty(spark, tables):
    assert op7_hilbert_shards(spark, tables(documents=([], DOCS))).collect() == []


def test_sql(spark, tables):
    """Without the row whose id repeats, whose two rows may take either's slot."""
    rows = [r for r in ODD if r[0] != 8]
    d = tables(documents=(rows, DOCS))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    got = op7_hilbert_shards(spark, d)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(op7_sql()).fetchall(), key=str)
    assert got.columns == [x[0] for x in con.execute(op7_sql()).description]


def test_repeated_rows_against_sql(spark, tables):
    """Rows that repeat get the same slots as in SQL, as a whole."""
    rows = [doc(i // 3, "some words " * (i // 9 % 4)) for i in range(90)]
    d = tables(documents=(rows, DOCS))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, op7_hilbert_shards(spark, d).collect()), key=str) == sorted(con.execute(op7_sql()).fetchall(), key=str)
