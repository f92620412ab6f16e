"""Near copies of whole texts: SimHash groups first, then candidates by shared rare shingles, all verified.

Rows with the same words in the same order (A-Z in lower case) are copies and become one. The
others' fingerprints, of five-word shingles, are linked by the trie self-join of operator 4, and
each text of such a group that is similar enough to the group's first joins it.

What fingerprints miss is found by shingles. These have an order, the same for all texts: those
that are common in a sample of texts come last, the rest go by hash. Two texts whose sets of n and
m shingles have a Jaccard similarity of t or more share one of their first n - ceil(t n) + 1 and
m - ceil(t m) + 1 shingles in that order, so texts that share none of these are no candidates, and
no pair is missed, whatever the sample. A pair goes on if the places of its shared shingle leave
room for the overlap that t needs. Each text's shingles are then counted by ranges of their hashes,
a byte for each shingle and some hundred at most: the lesser counts of two texts bound their overlap from above, so a pair
below t by that bound goes, and the rest is verified by the similarity of all shingles' 64-bit
hashes.

Groups are the components of verified links. All pairs of a shingle with CROWD texts or fewer are
tried. The texts of a more crowded one first meet one of them, HEADS times over: the one that has
most crowded shingles, as the text does that others were made from. Texts of a crowd that are still
of different components then meet in blocks of bounded size, in tasks that give back a spanning forest
of the pairs that the bounds allow. Two texts may share many crowded shingles, so their whole hashes
meet by the forests' components, where each text is once, and give only links that join two
components: no pairs of a crowd are ever rows.

Of each group the row with the least doc_id stays (null last; of repeated ids one row, whichever
was read first). A null text is an empty one; all texts without a word are copies of one another.
Very long texts are compared whole. An empty table gives an empty one, and a table's own columns
stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cloakframe.llm import simhash
from cloakframe.llm.common import by_bytes, discard, hot_join, stored, unused
from cloakframe.llm.simhash import shingle_digests, words
from cloakframe.llm.trie import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts, in expectation, that tell which shingles are common, and how many of them make one so.
SAMPLE = 4000
COMMON = 3
COMMON_KEPT = 200_000
#: log2 of the bits of a bitmap that goes to all tasks, at most.
WIDEST = 26
#: Texts with one shingle of which all pairs are tried at once.
CROWD = 32
#: Times that a crowd is tried against one of its texts before all pairs are.
HEADS = 2
#: Texts of a crowd, in expectation, that meet as many others in one task, by counts and by whole hashes.
BLOCK, WHOLE = 2048, 256
#: log2 of the ranges that hashes are counted by, at most.
RANGES = 9


def sketch(w: list[bytes], shingle_words: int = SHINGLE_WORDS) -> bytes:
    """The 64-bit hashes of all the text's shingles, ascending."""
    h = np.unique(np.frombuffer(shingle_digests(w, shingle_words), ">u8"))
    return h.astype("<u8").tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts' shingle hashes."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def spread(hashes: bytes) -> bytes:
    """How many of a text's shingle hashes lie in each of equal ranges, about as many as hashes, RANGES at most."""
    h = np.frombuffer(hashes, "<u8")
    bits = min(RANGES, max(3, math.ceil(math.log2(max(len(h), 1)))))
    counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    # A range too full for a byte makes no bound at all.
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_similar(a: bytes, b: bytes) -> float:
    """An upper bound of two texts' similarity by their spreads."""
    if not a or not b:
        return 1.0
    x, y = sorted((np.frombuffer(s, np.uint8).astype(np.int64) for s in (a, b)), key=len)
    y = y.reshape(len(x), -1).sum(axis=1)
    both, n = np.minimum(x, y).sum(), x.sum() + y.sum()
    return both / (n - both) if n else 1.0


def marked(docs: DataFrame, name: str) -> DataFrame:
    """docs' rows with their words' hash in a column of that name."""
    schema = StructType([*docs.schema.fields, StructField(name, StringType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [xxhash.xxh3_128_hexdigest(b" ".join(words(t))) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def packed(ids: DataFrame) -> DataFrame:
    """ids (id), none below zero: (of, bits), a row for 64 neighbouring ids."""
    return stored(ids.groupBy(F.shiftright("id", 6).alias("of")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id % 64 as int))")).alias("bits")), "packed")


def only(rows: DataFrame, row: str, ids: DataFrame) -> DataFrame:
    """The rows whose number, in a column, is one of the packed ids.

    Numbers are dense, so the ids go to all tasks as a bit for each row, and texts are never shuffled.
    """
    of, bits = unused(rows, "of"), unused(rows, "bits")
    words = F.broadcast(ids.select(F.col("of").alias(of), F.col("bits").alias(bits)))
    return rows.join(words, F.shiftright(row, 6) == F.col(of)).filter(F.getbit(bits, F.col(row) % 64) == 1).drop(of, bits)


def place(c: str, bits: int) -> Column:
    """The place of an id in a bitmap of so many bits, from 1."""
    return F.shiftrightunsigned(F.xxhash64(c), 64 - bits) + 1


def bitmap(ids: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bytes) of a bitmap that has the places of all ids, and few others; 2**WIDEST bits at most."""
    bits = min(WIDEST, max(16, math.ceil(math.log2(16 * ids.count() + 1))))
    at = ids.select(place("id", bits).alias("at"))
    got = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for part, own in zip(got.column("part").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[(part - 1) * len(own) : part * len(own)] = np.frombuffer(own, np.uint8)
    return bits, out


def shingle_sets(texts: DataFrame, form: Callable[[bytes], bytes], ids: DataFrame) -> DataFrame:
    """texts (id, text): (id, hashes), in a form of them, of all ids given and maybe of some others.

    A bitmap of bounded size tells them, so that texts are never shuffled.
    """
    bits, on = bitmap(ids)
    shared = texts.sparkSession.sparkContext.broadcast(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy() - 1
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            ids, texts = batch.column(0), batch.column(2).to_pylist()
            for a, b in by_bytes(texts):
                found = [form(sketch(words(t))) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(found, pa.binary())], names=["id", "hashes"])

    return texts.select("id", place("id", bits).alias("at"), "text").mapInArrow(run, "id long, hashes binary")


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, that many texts of a sample have, and how many. They only order the shingles."""
    of = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(sketch(words(t)), "<i8"))], names=["key"])

    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(of)) == 0).select("id", "text")
    counts = sample.mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= COMMON)
    got = counts.orderBy(F.desc("count"), "key").limit(COMMON_KEPT).toArrow()
    keys, n = got.column("key").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """texts (id, text): (key, id, n, at, common), the first of each text's n shingles and their places; common as in the sample."""
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = common.value
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in by_bytes(texts):
                firsts, sizes, places, often = [], [], [], []
                for t in texts[a:b]:
                    h = np.frombuffer(sketch(words(t)), "<u8")
                    seen = np.zeros(len(h), np.int64)
                    if len(keys):
                        place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        seen = np.where(keys[place] == h, counts[place], 0)
                        order = np.argsort(seen, kind="stable")
                        h, seen = h[order], seen[order]
                    sizes.append(len(h))
                    firsts.append(h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1])
                    often.append(seen[: len(firsts[-1])] > 0)
                    places.append(np.arange(len(firsts[-1]), dtype=np.int32))
                many = [len(x) for x in firsts]
                columns = [pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(ids[a:b], many)), pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(np.concatenate(places)), pa.array(np.concatenate(often))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "n", "at", "common"])

    return texts.select("id", "text").mapInArrow(run, "key long, id long, n int, at int, common boolean")


def shared(keys: DataFrame) -> DataFrame:
    """The rows of keys (key, id, n, at, common) whose key another row has too, and those of all common keys.

    Common keys need no second row to be found, so their rows are dealt by id and not by key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, common = batch.column(0).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            if held is not None and key[0] == before:
                yield held
            like = np.concatenate(([before is not None and key[0] == before], key[1:] == key[:-1]))
            on = like | np.concatenate((like[1:], [False])) | common
            yield batch.filter(pa.array(on))
            held, before = (None if on[-1] else batch.slice(batch.num_rows - 1)), key[-1]

    dealt = keys.repartition(F.when(F.col("common"), F.col("id")).otherwise(F.col("key"))).sortWithinPartitions("common", "key")
    return dealt.mapInArrow(run, keys.schema)


def by_key(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (key, common, ...) joined with facts (one row for each key, and its mark).

    Common keys are COMMON_KEPT at most, so their facts go to all tasks; of the others none has many rows.
    """
    common = facts.filter("common").drop("common")
    return rows.filter("not common").join(facts.filter("not common").drop("common"), "key").unionByName(rows.filter("common").join(F.broadcast(common), "key"))


def sifted(pairs: DataFrame, texts: DataFrame, form: Callable[[bytes], bytes], measure: Callable[[bytes, bytes], float], least: float, name: str) -> DataFrame:
    """pairs (a, b) of texts (id, text) whose sets, in a form of them, measure least or more."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(shingle_sets(texts, form, ends), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = [measure(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(on, pa.bool_()))

    found = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name)
    discard(sets)
    return found


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) of texts (id, text) that are similar enough."""
    near = sifted(pairs, texts, spread, most_similar, least, "near")
    found = sifted(near, texts, bytes, similarity, least, "verified")
    discard(near)
    return found


def _room(x: str, y: str, least: float) -> Column:
    """Whether the places of a shared shingle leave room for the overlap, in rows with n_ and at_ of both."""
    most = F.least(f"at_{x}", f"at_{y}") + F.least(F.col(f"n_{x}") - F.col(f"at_{x}"), F.col(f"n_{y}") - F.col(f"at_{y}"))
    return most >= least / (1 + least) * (F.col(f"n_{x}") + F.col(f"n_{y}")) - 1e-6


def _of(rows: DataFrame, which: str) -> DataFrame:
    return rows.select("key", "common", *[F.col(c).alias(f"{c}_{which}") for c in ("id", "n", "at", "root")])


def candidates(one: DataFrame, other: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of rows (key, id, n, at, common, root) of one key and different roots that may be similar enough."""
    x, y = _of(one, "x"), _of(other, "y")
    near = (x.drop("common").join(y, "key") if one is other else by_key(y, x)).filter((F.col("root_x") != F.col("root_y")) & _room("x", "y", least))
    if one is other:
        near = near.filter("id_x < id_y")
    return near.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def allowed(rows: pa.Table, spreads: list[bytes], least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners j) of a block's rows (n, at, root, part, low, high) that their bounds allow, each pair once.

    Rows of two parts that meet here meet no others of their own part.
    """
    n, at, root, part = (rows.column(c).to_numpy() for c in ("n", "at", "root", "part"))
    two = rows.num_rows and rows.column("low")[0] != rows.column("high")[0]
    forms: dict[int, np.ndarray] = {}
    for k, s in enumerate(spreads):
        forms.setdefault(len(s), []).append(k)
    tables = {size: (np.array(on), np.frombuffer(b"".join(spreads[k] for k in on), np.uint8).reshape(len(on), size)) for size, on in forms.items()}
    for size, (on, table) in tables.items():
        for wide, (others, right) in tables.items():
            # Similar sets' spreads differ in length by a factor of two at most; none at all bounds nothing.
            if not (size == wide or size * 2 == wide or 0 in (size, wide)) or (0 in (size, wide) and size > wide):
                continue
            right = np.minimum(right.reshape(len(others), size, -1).sum(axis=2), 65535).astype(np.uint16) if size and wide > size else right
            for row, i in enumerate(on):
                j = others[others > i] if size == wide else others
                need = least / (1 + least) * (n[i] + n[j]) - 1e-6
                ok = (root[j] != root[i]) & (np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j]) >= need)
                if two:
                    ok &= part[j] != part[i]
                if size and wide and ok.any():
                    places = np.flatnonzero(others > i)[ok] if size == wide else np.flatnonzero(ok)
                    ok[ok] = np.minimum(right[places], table[row]).sum(axis=1, dtype=np.int64) >= need[ok]
                if ok.any():
                    yield int(i), j[ok]


def in_blocks(dealt: DataFrame, texts: DataFrame, form: Callable[[bytes], bytes], run: Callable[[pa.Table], pa.Table], schema: str, name: str) -> DataFrame:
    """run over the rows (key, parts, id, n, at, root) of each key that meet in blocks, with a form of their hashes."""
    sets = stored(shingle_sets(texts, form, dealt.select("id").distinct()), "sets")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    meets = dealt.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = meets.select("key", F.least("part", "meets").alias("low"), F.greatest("part", "meets").alias("high"), "part", "id", "n", "at", "root")
    found = stored(meets.join(sets, "id").groupBy("key", "low", "high").applyInArrow(run, schema), name)
    discard(sets)
    return found


def crowd_links(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) that join the roots of rows (key, common, id, n, at, root), as many as that takes."""

    def joining(nodes: pa.ChunkedArray, block: pa.Table, spreads: list[bytes], ok: Callable[[int, int], bool]) -> pa.Table:
        """Allowed pairs of a block that are ok and join two of the nodes that its rows are of."""
        ids, links = block.column("id").to_pylist(), []
        of = np.unique(nodes.to_numpy(), return_inverse=True)[1]
        for i, partners in allowed(block, spreads, least):
            for j in partners[of[partners] != of[i]]:
                if of[j] != of[i] and ok(i, j):
                    of[of == of[j]] = of[i]
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    def partnered(block: pa.Table) -> pa.Table:
        return joining(block.column("id"), block, block.column("hashes").to_pylist(), lambda i, j: True)

    def joined(block: pa.Table) -> pa.Table:
        sets = block.column("hashes").to_pylist()
        return joining(block.column("root"), block, [spread(h) for h in sets], lambda i, j: similarity(sets[i], sets[j]) >= least)

    def parts(rows: DataFrame, block: int) -> DataFrame:
        return rows.agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))

    some = in_blocks(by_key(rows, parts(rows.groupBy("key", "common"), BLOCK)), texts, spread, partnered, "a long, b long", "partnered")
    groups = components(some)
    # Any pair that is allowed by a shared key is in one group, whatever its keys' places.
    once = rows.select("id", "n", "root").distinct().join(groups.select(F.col("node").alias("id"), F.col("root").alias("key")), "id")
    once = stored(once.withColumn("at", F.lit(0)), "once")
    found = in_blocks(hot_join(once, parts(once.groupBy("key"), WHOLE), "key"), texts, bytes, joined, "a long, b long", "joined")
    discard(some, groups, once)
    return found.distinct()


def near_groups(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """texts (id, text), ids distinct: (id, root) of all that have a verified link to another."""
    alike = simhash.near_groups(texts.select(F.col("id").alias("doc_id"), "text"), SHINGLE_WORDS)
    pairs = stored(alike.filter("component_id <> doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")), "pairs")
    links = verified(pairs, texts, least)
    last = components(links)
    keys = stored(shared(prefixes(texts, least)), "keys")
    # A key that is common in the sample counts as crowded.
    rare = keys.filter("not common")
    sized = stored(rare.join(rare.groupBy("key").agg(F.count("*").alias("texts")), "key"), "sized")
    crowded = sized.filter(F.col("texts") > CROWD).drop("texts").unionByName(keys.filter("common").select("key", "id", "n", "at", "common"))
    # How many crowded shingles a text has tells how central it is.
    many = stored(crowded.join(crowded.groupBy("id").agg(F.count("*").alias("crowds")), "id"), "many")
    done, tried = [pairs, links, keys, sized, many], pairs

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(last.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    for turn in range(HEADS + 1):
        # In a crowd only texts of different classes are still to be tried.
        now = stored(rooted(many), "rooted")
        open_keys = now.groupBy("key", "common").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key", "common")
        rest = stored(by_key(now, open_keys), "open")
        discard(now)
        done.append(rest)
        if turn and rest.isEmpty():
            break
        if turn == HEADS:
            more = stored(crowd_links(rest, texts, least), "verified")
        else:
            rank = F.struct(F.col("crowds") if turn == 0 else F.lit(0), F.xxhash64("id", F.lit(turn)))
            heads = rest.groupBy("key", "common").agg(F.max_by(F.struct("id", "n", "at", "root"), rank).alias("head")).select("key", "common", "head.*")
            pairs = candidates(heads, rest, least)
            if not turn:
                few = rooted(sized.filter(F.col("texts") <= CROWD).drop("texts"))
                pairs = pairs.unionByName(candidates(few, few, least)).distinct()
            pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            more = verified(pairs, texts, least)
            tried = tried.unionByName(pairs)
            done.append(pairs)
        links = links.unionByName(more)
        done += [more, last]
        last = components(links)
    discard(*done)
    return last.withColumnRenamed("node", "id")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each group of docs, with all its columns."""
    names, sig = docs.columns, unused(docs, "sig")
    row = unused(docs, "row")
    rows = stored(marked(docs, sig).withColumn(row, F.monotonically_increasing_id()), "marked")
    # Copies first become one, so a hot group is a single row before it meets its root.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    classes = stored(rows.groupBy(F.col(sig).alias("sig")).agg(F.min(rank).alias("first")).select("first", F.col("first.row").alias("id")), "classes")
    firsts = packed(classes.select("id"))
    roots = near_groups(only(rows.select(F.col(row).alias("id"), "text"), "id", firsts), least)
    discard(firsts)
    stay = classes.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("id"))
    return only(rows, row, packed(stay)).select(*[f"`{c}`" for c in names])
