import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import cloakframe.llm.trie as trie
from cloakframe.llm.simhash import majority, op4_simhash_trie, shingle_digests, words
from helpers import DOCS, ODD, doc


def plain_fingerprint(text):
    w = words(text)
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


@given(st.lists(st.text(alphabet="aB \n\té", max_size=30), max_size=6))
def test_fingerprints(texts):
    assert majority([shingle_digests(words(t), 3) for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def cluster(rng, n, centres):
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 3))
def test_leaf_links_are_all_pairs(seed, budget):
    rng = random.Random(seed)
    x, y = cluster(rng, 120, 5), cluster(rng, 90, 4)
    y[:30] = np.sort(x[:30] ^ np.uint64(5))
    y = np.unique(y)
    got = {(int(i), int(j)) for i, j, _ in ((a, b, d) for t in trie.leaf_links(x, None, 0, 0, budget) for a, b, d in zip(*t))}
    assert got == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= budget}
    got = {(int(a), int(b)) for t in trie.leaf_links(x, y, 0, 0, budget) for a, b, _ in zip(*t)}
    assert got == {(i, j) for i in range(len(x)) for j in range(len(y)) if int(x[i] ^ y[j]).bit_count() <= budget}


def test_against_all_pairs(spark, tables):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    rows = list(ODD)
    for i in range(20, 50):
        w = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(400)]
        rows.append(doc(i, " ".join(w)))
        for k in range(rng.randrange(3)):
            w[rng.randrange(400)] = "changed"
            rows.append(doc(100 * i + k, " ".join(w)))
    got = sorted(map(tuple, op4_simhash_trie(spark, tables(documents=(rows, DOCS))).collect()), key=str)
    assert got == plain_components(rows)
    assert len({r[2] for r in got}) < len({r[1] for r in got})


def test_crowded_prefixes(spark, monkeypatch):
    monkeypatch.setattr(trie, "LEAF", 16)
    x = cluster(random.Random(3), 300, 3)
    fps = spark.createDataFrame([(0, int(v)) for v in x.view(np.int64)], "view int, fp long")
    got = {tuple(r) for r in trie.components(trie.links(fps)).collect()}
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in range(i):
            if int(x[i] ^ x[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, v in enumerate(x.view(np.int64).tolist()):
        groups.setdefault(find(i), []).append(v)
    assert got == {(v, min(g)) for g in groups.values() if len(g) > 1 for v in g}


def test_empty(spark, tables):
    assert op4_simhash_trie(spark, tables(documents=([], DOCS))).collect() == []
