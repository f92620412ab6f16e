"""Hamming self-join of 64-bit fingerprints over a binary trie, and connected components.

The trie's nodes are prefixes. Pairs of nodes descend together from the top; each level adds a
bit to both, a pair that has spent its error budget is cut off, and small pairs are compared
directly. The upper levels are rows, STEP bits at a time: fingerprints are gathered into subtrees
(leaves) of bounded size, deeper where a prefix is crowded, and pairs of nodes go down to pairs of
leaves as rows of prefixes only; the leaves' arrays join what is left. The lower levels run inside
a task on the two leaves' sorted arrays.

A leaf never has over LEAF fingerprints, as equal ones count once. A pair of leaves returns a
minimum spanning forest of its links rather than all of them: at most one link for each
fingerprint, and the same components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import discard, hot_join, stored

#: Fingerprints in a leaf, at most.
LEAF = 1 << 13
#: Node pairs that a task holds at once, and fingerprint pairs that it compares at once.
FRONTIER = 1 << 18
COMPARE = 1 << 20
#: Node pairs with no more fingerprint pairs than this are compared directly.
DIRECT = 64
STEP = 4
#: Edges that one task may have, whatever their nodes.
FEW = 1 << 16


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of a minimum spanning forest's links, by Boruvka's rounds."""
    label, kept = np.arange(n), []
    key = d.astype(np.int64) << 40 | np.arange(len(i))
    none = np.iinfo(np.int64).max
    on = np.arange(len(i))
    while len(on):
        a, b = label[i[on]], label[j[on]]
        apart = a != b
        on, a, b = on[apart], a[apart], b[apart]
        if not len(on):
            break
        best = np.full(n, none)
        np.minimum.at(best, a, key[on])
        np.minimum.at(best, b, key[on])
        links = np.unique(best[best != none] & ((1 << 40) - 1))
        kept.append(links)
        a, b = label[i[links]], label[j[links]]
        while True:  # the linked components take their smallest label
            low = np.minimum(a, b)
            to = np.arange(n)
            np.minimum.at(to, a, low)
            np.minimum.at(to, b, low)
            while not np.array_equal(to, to[to]):
                to = to[to]
            label = to[label]
            a, b = to[a], to[b]
            if np.array_equal(a, b):
                break
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def leaf_links(x: np.ndarray, y: np.ndarray | None, depth: int, spent: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of x[i], y[j] (y None: of x, i < j) within the budget.

    Both are sorted and share their first depth bits among themselves; spent of those differ.
    """
    same = y is None
    y = x if same else y
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in ones:
            bit = np.uint64(63 - level)
            a = np.concatenate(([0], np.cumsum((x >> bit) & np.uint64(1), dtype=np.int64)))
            ones[level] = (a, a if same else np.concatenate(([0], np.cumsum((y >> bit) & np.uint64(1), dtype=np.int64))))
        return ones[level]

    def compare(p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sizes = (p[1] - p[0]) * (p[3] - p[2])
        at, total = 0, np.cumsum(sizes)
        while at < len(sizes):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COMPARE, "right")))
            q, size = p[:, at:upto], sizes[at:upto]
            row = np.repeat(np.arange(upto - at), size)
            k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            width = (q[3] - q[2])[row]
            i, j = q[0][row] + k // width, q[2][row] + k % width
            d = np.bitwise_count(x[i] ^ y[j])
            ok = d <= budget
            if same:
                ok &= i < j
            yield i[ok], j[ok], d[ok]
            at = upto

    stack = [(depth, np.array([[0], [len(x)], [0], [len(y)], [spent]], np.int64))]
    while stack:
        level, p = stack.pop()
        direct = ((p[1] - p[0]) * (p[3] - p[2]) <= DIRECT) if level < 64 else np.ones(p.shape[1], bool)
        if direct.any():
            yield from compare(p[:, direct])
        p = p[:, ~direct]
        if not p.shape[1]:
            continue
        a, b = counts(level)
        mid_a, mid_b = p[1] - (a[p[1]] - a[p[0]]), p[3] - (b[p[3]] - b[p[2]])
        both = [
            np.stack((p[0], mid_a, p[2], mid_b, p[4])),
            np.stack((mid_a, p[1], mid_b, p[3], p[4])),
            np.stack((p[0], mid_a, mid_b, p[3], p[4] + 1)),
        ]
        cross = np.stack((mid_a, p[1], p[2], mid_b, p[4] + 1))
        both.append(cross[:, p[0] != p[2]] if same else cross)
        q = np.concatenate(both, axis=1)
        q = q[:, (q[0] < q[1]) & (q[2] < q[3]) & (q[4] <= budget)]
        for s in range(0, q.shape[1], FRONTIER):
            stack.append((level + 1, q[:, s : s + FRONTIER]))


def pair_forest(x: np.ndarray, y: np.ndarray | None, depth: int, spent: int, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links between two leaves, or within one: values and distances."""
    nodes = x if y is None else np.concatenate((x, y))
    shift = 0 if y is None else len(x)
    i = j = d = np.empty(0, np.int64)
    for a, b, e in leaf_links(x, y, depth, spent, budget):
        if not len(a):
            continue
        i, j, d = np.concatenate((i, a)), np.concatenate((j, b + shift)), np.concatenate((d, e.astype(np.int64)))
        if len(i) > 4 * len(nodes) + COMPARE:
            on = forest(len(nodes), i, j, d)
            i, j, d = i[on], j[on], d[on]
    on = forest(len(nodes), i, j, d)
    return nodes[i[on]], nodes[j[on]], d[on]


def _leaves(fps: DataFrame, n: int) -> DataFrame:
    """fps (view, fp): (view, depth, prefix, block), each leaf's fingerprints as one binary."""
    depth, rest, found = max(8, STEP * math.ceil(math.log2(max(n, 1) / LEAF) / STEP)), fps, []
    while True:
        keyed = rest.withColumn("prefix", F.shiftrightunsigned("fp", 64 - depth))
        sizes = keyed.groupBy("view", "prefix").count()
        # A list is gathered only for prefixes that have no more than LEAF.
        crowded = stored(sizes.filter(F.col("count") > LEAF).select("view", "prefix"), "crowded") if depth < 64 else None
        more = crowded is not None and not crowded.isEmpty()
        small = keyed.join(crowded, ["view", "prefix"], "left_anti") if more else keyed
        found.append(small.groupBy("view", "prefix").agg(F.array_sort(F.collect_list("fp")).alias("block")).select("view", F.lit(depth).alias("depth"), "prefix", "block"))
        if not more:
            break
        rest = stored(keyed.join(crowded, ["view", "prefix"], "left_semi").select("view", "fp"), "rest")
        depth += STEP
    leaves = found[0]
    for x in found[1:]:
        leaves = leaves.unionByName(x)
    return leaves


LINKS = "view int, a long, b long, distance int"


PAIRS = "view int, da int, pa long, la boolean, db int, pb long, lb boolean, spent int"


def _descended(leaves: DataFrame, budget: int) -> DataFrame:
    """PAIRS of leaves (view, depth, prefix) that the budget allows: node pairs go down from the top together.

    Each level adds STEP bits to both nodes of a pair. A leaf waits for its partner to become one, and
    bits beyond the leaf's depth aren't counted yet.
    """
    spark = leaves.sparkSession
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    top = leaves.select("view").distinct()
    pairs = top.select("view", F.lit(0).alias("da"), F.lit(0).cast("long").alias("pa"), F.lit(False).alias("la"), F.lit(0).alias("db"), F.lit(0).cast("long").alias("pb"), F.lit(False).alias("lb"), F.lit(0).alias("spent"))
    for depth in range(STEP, deepest + 1, STEP):
        nodes = leaves.filter(F.col("depth") >= depth)
        nodes = nodes.select("view", F.expr(f"shiftrightunsigned(prefix, depth - {depth})").alias("node"), (F.col("depth") == depth).alias("leaf")).distinct()
        nodes = nodes.withColumn("parent", F.shiftrightunsigned("node", STEP))
        pairs = pairs.withColumn("same", (F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb")) & ~F.col("la"))
        for side in ("a", "b"):
            children = nodes.select("view", F.col("parent").alias(f"p{side}"), F.col("node").alias("child"), "leaf")
            gone = pairs.filter(~F.col(f"l{side}")).join(children, ["view", f"p{side}"])
            gone = gone.withColumn(f"p{side}", F.col("child")).withColumn(f"l{side}", F.col("leaf")).withColumn(f"d{side}", F.lit(depth)).drop("child", "leaf")
            pairs = gone.unionByName(pairs.filter(F.col(f"l{side}")))
        both = (F.col("da") == depth) & (F.col("db") == depth)
        more = F.when(both, F.bit_count(F.col("pa").bitwiseXOR(F.col("pb")).bitwiseAND(F.lit((1 << STEP) - 1)))).otherwise(F.lit(0))
        pairs = pairs.withColumn("spent", (F.col("spent") + more).cast("int")).filter((F.col("spent") <= budget) & (~F.col("same") | (F.col("pa") <= F.col("pb"))))
        pairs = stored(pairs.select(*[x.split()[0] for x in PAIRS.split(", ")]), "pairs")
    return pairs if deepest else spark.createDataFrame([], PAIRS)


LINKS = "view int, a long, b long, distance int"


def links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """fps (view int, fp long), distinct: links (view, a, b, distance) that span each component.

    Fingerprints of different views are never compared.
    """
    fps = stored(fps, "fingerprints")
    leaves = stored(_leaves(fps, fps.count()), "leaves")
    pairs = _descended(leaves.select("view", "depth", "prefix"), budget)
    # The node that ended first comes first: its depth is what both share.
    first = F.col("da") <= F.col("db")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    pairs = pairs.select("view", pick("da", "db").alias("da"), pick("pa", "pb").alias("pa"), pick("db", "da").alias("db"), pick("pb", "pa").alias("pb"), "spent")
    x = leaves.select("view", F.col("depth").alias("da"), F.col("prefix").alias("pa"), F.col("block").alias("x"))
    y = leaves.select("view", F.col("depth").alias("db"), F.col("prefix").alias("pb"), F.col("block").alias("y"))
    both = pairs.join(x, ["view", "da", "pa"]).join(y, ["view", "db", "pb"])
    ready = both.select("view", "da", "spent", ((F.col("da") == F.col("db")) & (F.col("pa") == F.col("pb"))).alias("same"), "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                view, depth, spent, same = (batch.column(c)[k].as_py() for c in range(4))
                x, y = (np.sort(batch.column(c)[k].values.to_numpy().view(np.uint64)) for c in (4, 5))
                a, b, d = pair_forest(x, None if same else y, depth, spent, budget)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"view": pa.array([view] * len(a), pa.int32()), "a": a.view(np.int64), "b": b.view(np.int64), "distance": pa.array(d, pa.int32())})

    return ready.mapInArrow(run, LINKS)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the edges: root is the least node of its component.

    Alternating large and small stars; no group is gathered, only minima. Hubs with many rows meet
    their least node in every task, the others are dealt by node. Each round is written to the shared
    folder, and the one before deleted. RuntimeError if the rounds don't suffice.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    # Few edges fit a task whatever their hubs.
    meet = hot_join if now.count() > FEW else (lambda stars, least, key: stars.join(least, key))
    mark = None
    for _ in range(rounds):
        # Large star: every neighbour above a node goes to the least of the node's neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(now.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "large")
        discard(now)
        # Small star: a node and its lower neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large.select("u", F.col("v").alias("w")), low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small")
        discard(large)
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            out = stored(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
            discard(now)
            return out
        mark = new
    raise RuntimeError(f"components are not stable after {rounds} rounds")
