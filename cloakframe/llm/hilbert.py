"""Operator 7: shards as runs of a Hilbert curve over several metadata dimensions.

Every dimension is quantised to a few bits; a table-driven walk from the highest bits down gives
a row's place on the curve, as one SQL expression. Rows are sorted by place, then by a hash of
their key, so that one crowded place still spreads over many tasks, and equal runs are cut. All
of it is DataFrame and SQL functions.

Null values: a null in a dimension has the cell of an empty value; a null text has size 1 and the
checksum 0; a null doc_id is a key like any other. Repeated rows get slots of their own, and a key
with many rows is dealt over many tasks. Very long texts are only measured. An empty table gives an
empty one. Columns that have the names of the results are replaced; others stay.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.llm.common import stored, unused

BITS = 5
SHARDS = 8


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """For state * 2**n + cell: the cell's digit on the curve, and the state within that cell.

    A state is an entry corner and a direction; within it the cells follow a Gray code.
    """
    size = 1 << n
    turn = lambda x, k: ((x << k % n) | (x >> n - k % n)) & size - 1
    gray = lambda x: x ^ x >> 1
    ones = lambda x: (~x & x + 1).bit_length() - 1  # noqa: E731  ones that x ends with
    digits, states = [0] * (size * size * n), [0] * (size * size * n)
    for entry in range(size):
        for way in range(n):
            for w in range(size):
                cell = turn(gray(w), way + 1) ^ entry
                corner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                bend = 0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n
                at = (entry * n + way) * size + cell
                digits[at] = w
                states[at] = (entry ^ turn(corner, way + 1)) * n + (way + bend + 1) % n
    return digits, states


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The place on the curve of whole numbers below 2**bits, as one expression."""
    n = len(dims)
    digits, states = curve_table(n)
    digit, state = (F.array(*[F.lit(x) for x in t]) for t in (digits, states))
    cells = [sum((F.shiftright(d.cast("int"), k).bitwiseAND(F.lit(1)) * (1 << i) for i, d in enumerate(dims)), F.lit(0)) for k in reversed(range(bits))]
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))

    def step(acc: Column, cell: Column) -> Column:
        at = acc["s"] * (1 << n) + cell + 1
        return F.struct(F.element_at(state, at).alias("s"), (acc["h"] * (1 << n) + F.element_at(digit, at)).alias("h"))

    return F.aggregate(F.array(*cells), start, step, lambda acc: acc["h"])


def by_hash(c: str, bits: int = BITS) -> Column:
    """A cell of a column without an order; null has the cell of an empty value."""
    return (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % (1 << bits)).cast("int")


def by_size(c: str, bits: int = BITS) -> Column:
    """Two cells for each doubling of a positive number."""
    return F.least(F.floor(2 * F.log2(F.greatest(F.col(c), F.lit(1)).cast("double"))).cast("int"), F.lit((1 << bits) - 1))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with its row's number (from 0) in this order, as rank, and the number of rows, as total.

    Rows are dealt by ranges of the order; only one number for each range meets in one place.
    """
    own, part, seq = [c for c in df.columns if c not in ("rank", "total")], unused(df, "part"), unused(df, "seq")
    before, within = unused(df, "before"), unused(df, "within")
    # Rows that are alike in the order are told apart by where they were read, so they spread too.
    dealt = df.select(*[f"`{c}`" for c in own]).withColumn(seq, F.monotonically_increasing_id()).repartitionByRange(*order, seq)
    dealt = stored(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("rows"))
    places = sizes.select(part, (F.sum("rows").over(W.orderBy(part)) - F.col("rows")).alias(before), F.sum("rows").over(W.partitionBy()).alias("total"))
    numbered = dealt.withColumn(within, F.row_number().over(W.partitionBy(part).orderBy(*order, seq)))
    # places has a row for each shuffle partition, which bounds it.
    ranks = numbered.join(F.broadcast(places), part).withColumn("rank", F.col(before) + F.col(within) - 1)
    return ranks.drop(part, seq, before, within)


def shard_runs(df: DataFrame, dims: list[Column], key: str, shards: int = SHARDS) -> DataFrame:
    """df with hilbert, shard and slot: runs of the curve whose row counts differ by one at most."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("hilbert", "shard", "slot")]
    kept = df.select(*rest)
    place, tie, own = unused(kept, "place"), unused(kept, "tie"), unused(kept, "row")
    # df's own columns ride along in one, so that no name of theirs meets one of the numbering's.
    placed = df.select(F.struct(*rest).alias(own), hilbert_index(dims).alias(place), F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias(tie), F.col(f"`{key}`").alias("key"))
    rows = ranked(placed, [place, tie, "key"])
    shard = F.expr(f"cast(rank * {shards} div total as int)")
    first = F.expr(f"(rank * {shards} div total * total + {shards - 1}) div {shards}")
    return rows.select(f"{own}.*", F.col(place).alias("hilbert"), shard.alias("shard"), (F.col("rank") - first).alias("slot"))


def run_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """For each shard the least and the greatest value of each column: what a reader prunes by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in 8 runs over source, language and size; law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select("doc_id", "source", "lang", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # The cells are computed before the rows are dealt, so only numbers move.
    cells = facts.select("doc_id", "size", "text_crc32", by_hash("source").alias("d0"), by_hash("lang").alias("d1"), by_size("size").alias("d2"))
    runs = shard_runs(cells, [F.col("d0"), F.col("d1"), F.col("d2")], "doc_id")
    return runs.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def _crc32_sql(digits: str) -> str:
    """crc32 of the bytes with these hex digits in DuckDB, which has no such function: by a table."""
    values = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    # The table's entries are the checksums' inner states after each single byte.
    table = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, list_extract({table}::BIGINT[], xor(c, b) % 256 + 1))), 4294967295)"


def op7_sql(bits: int = BITS, shards: int = SHARDS) -> str:
    """DuckDB SQL for the contract query."""
    digits, states = curve_table(3)
    levels, source = [], "cells"
    for k in reversed(range(bits)):
        at = f"s * 8 + ((d0 >> {k}) & 1) + 2 * ((d1 >> {k}) & 1) + 4 * ((d2 >> {k}) & 1) + 1"
        levels.append(f"l{k} AS (SELECT * REPLACE (list_extract({states}, {at}) AS s, h * 8 + list_extract({digits}, {at}) AS h) FROM {source})")
        source = f"l{k}"
    code = f"{_crc32_sql('x')} % {1 << bits}"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents),
    sources AS (SELECT source, {code} AS d0 FROM (SELECT DISTINCT source, hex(encode(source)) AS x FROM texts)),
    langs AS (SELECT lang, {code} AS d1 FROM (SELECT DISTINCT lang, hex(encode(lang)) AS x FROM texts)),
    facts AS (SELECT doc_id, strlen(text) + 1 AS size, {_crc32_sql("x")} AS text_crc32, d0, d1 FROM (SELECT *, hex(encode(text)) AS x FROM texts) JOIN sources USING (source) JOIN langs USING (lang)),
    cells AS (SELECT *, least(floor(2 * log2(greatest(size, 1)::DOUBLE))::INT, {(1 << bits) - 1}) AS d2, 0 AS s, 0::BIGINT AS h FROM facts),
    {", ".join(levels)},
    ranked AS (SELECT *, row_number() OVER (ORDER BY h, md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM {source}),
    cut AS (SELECT *, (r * {shards} // n)::INT AS shard FROM ranked)
    SELECT doc_id, size, text_crc32, 'rows' AS law, shard, r - (shard * n + {shards - 1}) // {shards} AS slot, CAST(NULL AS INT) AS grown_shard, h AS hilbert FROM cut"""
