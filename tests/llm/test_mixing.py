import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cloakframe.llm import mixing
from cloakframe.llm.mixing import CELLS, GATES, NOTHING, SAME, Code, Counts, Group, LogOdds, Model, Texts, leading, op6_context_mixing, widths
from helpers import DOCS, ODD, doc

U = (1 << 64) - 1


def tokens(text):
    return (text or "").encode().lower().split()


def test_code():
    for counts in ([1, 1], [5, 1, 1, 9, 30], list(range(1, 300)), [1 << k for k in range(30)]):
        code = Code(counts)
        assert sum(2.0 ** -int(n) for n in code.length) == 1
        words = {tuple(code.bits[: code.length[s], s]) for s in range(code.size)}
        assert len(words) == code.size
        # A node is one and the same run of bits.
        seen = {}
        for s in range(code.size):
            for k in range(code.length[s]):
                assert seen.setdefault(int(code.path[k, s]), tuple(code.bits[:k, s])) == tuple(code.bits[:k, s])
        assert len(seen) == code.size - 1 and set(seen) == set(range(code.size - 1))


def texts(rng, n, size):
    """Texts as numbers with an end (size - 2), some words escaped (size - 1), and what followers foretold."""
    out = []
    for i in range(n):
        ids = [rng.randrange(size - 2) // rng.choice([1, 1, 4]) if rng.random() < 0.9 else size - 1 for _ in range(rng.randrange(0, 60))] * rng.choice([1, 2]) + [size - 2]
        told = [[x if rng.random() < 0.6 else rng.choice([NOTHING, size - 1, SAME, rng.randrange(size - 1)]) for x in ids] for _ in range(2)]
        told = [[(size - 1 if t == SAME and x != size - 1 else t) for t, x in zip(f, ids)] for f in told]
        out.append((np.array(ids, np.uint16), np.array(told[0], np.uint16), np.array(told[1], np.uint16), 0, len(ids), i % 3 > 0))
    return out


@pytest.fixture(scope="module")
def learnt():
    rng = random.Random(4)
    size = 42
    parts = texts(rng, 150, size)
    code = Code([1 + 200 // (k + 1) for k in range(size)])
    counts = Counts(code, widths(2000))
    flat = np.zeros(counts.size, np.uint32)
    trained = Group([p for p in parts if p[5]], size)
    counts.add(trained, flat)
    model = Model.of(code, widths(2000), flat)
    curve = np.full((GATES, mixing.N), 20.0)
    model.learn(trained, curve)
    return model, parts


def mix(h):
    h = (h ^ h >> 31) * int(mixing._M) & U
    return h ^ h >> 29


def slow(model, part, rest):
    """log10 of a text, bit after bit."""
    ids, followers, train = [int(x) for x in part[0]], [[int(x) for x in f] for f in part[1:3]], part[5]
    code, size = model.code, model.code.size
    refined = model.refined()
    gains, total, left = np.zeros((2, mixing.STATES)), 0.0, list(rest)
    squash = lambda t: 1 / (1 + math.exp(-max(-20, min(20, t))))
    hit = lambda f, i: f[i] == SAME if ids[i] == size - 1 else f[i] == ids[i]
    for i, s in enumerate(ids):
        who = next((j for j in (1, 0) if followers[j][i] != NOTHING), None)
        if who is not None:
            n = 0
            while n < i and hit(followers[who], i - 1 - n):
                n += 1
            q = model.same[who, min(int(math.log2(n + 1)), mixing.RUNS - 1)]
            right = hit(followers[who], i)
            total += math.log10(q if right else 1 - q)
            if right:
                if s == size - 1:
                    left.pop(0)
                continue
        w = [(ids[i - k] if i >= k else size) + 1 for k in (1, 2)]
        h1 = mix(w[0] * int(mixing._G) & U)
        contexts = [h1, mix(h1 + w[1] & U)]
        state = 0 if who is None else who + 1
        learnt = np.zeros((2, mixing.STATES))
        for k in range(code.length[s]):
            node, bit = int(code.path[k, s]), int(code.bits[k, s])
            x, longest = [], 0
            for c in range(3):
                slot = node if c == 0 else ((contexts[c - 1] ^ node * int(mixing._G) & U) * int(mixing._M) & U) >> 64 - model.wide[c - 1]
                n0, n1 = (float(v) for v in model.tables[c][slot])
                n0, n1 = max(0, n0 - (train and bit == 0)), max(0, n1 - (train and bit == 1))
                x.append(math.log((n1 + mixing.PRIOR) / (n0 + mixing.PRIOR)))
                longest = c if c and n0 + n1 > 0 else longest
            gate = (min(k, mixing.PLACES - 1) * mixing.SEEN + longest) * mixing.STATES + state
            t = max(-20, min(20, float(np.dot(model.w[gate], x))))
            p = squash(t)
            learnt[:, state] += (bit - p) * t, p * (1 - p) * t * t
            t *= min(2, max(0.5, 1 + gains[0, state] / (gains[1, state] + mixing.HELD)))
            cell = min(max(round(t * 2) + CELLS // 2, 0), CELLS - 1)
            p = (squash(t) + refined[gate * CELLS + cell]) / 2
            total += math.log10(max(p if bit else 1 - p, 1e-7))
        gains += learnt
        if s == size - 1:
            total += left.pop(0)
    return total


def unforetold(model, part, rest):
    """rest without the escaped words that a follower foretells."""
    g = Group([part], model.code.size)
    return rest[~g.right[g.ids == model.code.size - 1]]


def scores(model, parts, monkeypatch=None):
    rng = np.random.default_rng(5)
    rest = [-rng.random(int((p[0] == model.code.size - 1).sum())) * 6 for p in parts]
    got, _ = model.log10(Group(parts, model.code.size), np.concatenate([unforetold(model, p, r) for p, r in zip(parts, rest)]))
    return got, [slow(model, p, r) for p, r in zip(parts, rest)]


def test_against_bit_after_bit(learnt):
    model, parts = learnt
    got, want = scores(model, parts[:40])
    assert np.allclose(got, want, rtol=2e-3, atol=2e-2) and min(want) < -20


def test_chunks_and_pieces_change_little(learnt, monkeypatch):
    """A text's gains go on from chunk to chunk and from piece to piece."""
    model, parts = learnt
    whole, _ = scores(model, parts[:40])
    monkeypatch.setattr(mixing, "STEP", 17)
    small, _ = scores(model, parts[:40])
    assert np.allclose(whole, small, rtol=1e-4, atol=1e-3)
    part = max(parts, key=lambda p: len(p[0]))
    part = (np.tile(part[0][:-1], 9), np.tile(part[1][:-1], 9), np.tile(part[2][:-1], 9), 0, 9 * len(part[0]) - 9, False)
    n, cut = part[4], part[4] // 2
    none = lambda g: np.zeros(len(g.escapes))
    one, _ = model.log10(g := Group([part], model.code.size), none(g))
    a, left = model.log10(g := Group([(*part[:3], 0, cut, False)], model.code.size), none(g))
    b, _ = model.log10(g := Group([(*part[:3], cut, n, False)], model.code.size), none(g), left)
    assert abs(one[0] - a[0] - b[0]) < 0.02 * abs(one[0])


def test_long_codes_against_bit_after_bit():
    """Codes of up to 41 bits: products of many small probabilities stay what a double holds."""
    rng, size, counts = random.Random(6), 42, [1, 1]
    while len(counts) < size:
        counts.append(counts[-1] + counts[-2])
    parts, code = texts(rng, 30, size), Code(counts)
    assert code.length.max() == size - 1
    model = Model.of(code, widths(500), np.zeros(Counts(code, widths(500)).size, np.uint32))
    got, want = scores(model, parts)
    assert np.allclose(got, want, rtol=2e-3, atol=2e-2) and min(want) < -300


def test_levels_take_the_longest_codes_first(learnt):
    model, parts = learnt
    g, before, bits = Group(parts, model.code.size), None, 0
    for k, on, node, bit in g.levels(model.code, 0, g.n):
        assert before is None or on.tolist() == before[: len(on)].tolist()
        assert node.tolist() == model.code.path[k, g.ids[on]].tolist() and bit.tolist() == model.code.bits[k, g.ids[on]].tolist()
        before, bits = on, bits + len(on)
    assert bits == int(model.code.length[g.ids[~g.right]].sum()) > 0


def test_log_odds_are_looked_up(learnt):
    """Looked up for one kind of texts or for both, they are those of the counts; the lowest bit tells what was seen."""
    model, parts = learnt
    for some, own in (([p for p in parts if p[5]], [1]), ([p for p in parts if not p[5]], [0]), (parts, [0, 1])):
        looked = LogOdds(model, Group(some, model.code.size))
        assert looked.own == own
        for table, pairs in zip(looked.tables, model.tables):
            for rows, less in zip(table.reshape(len(own), -1, 2), own):
                for bit in (0, 1):
                    hit, miss = np.maximum(pairs[:, bit].astype(int) - less, 0), pairs[:, 1 - bit].astype(int)
                    assert np.allclose(rows[:, bit], np.log((hit + mixing.PRIOR) / (miss + mixing.PRIOR)), atol=1e-5)
                    assert ((np.ascontiguousarray(rows[:, bit]).view(np.uint32) & 1) == (hit + miss > 0)).all()


def test_numbers_of_words():
    """Many texts at once get the numbers that word after word would get."""
    made = [t or "" for _, t, *_ in ODD] + ["\x0b a  b\x0cA\r", "x\xa0y \x1c z\x85", "\u2003Q q", "b a b"]
    held = [i % 3 == 0 for i in range(len(made))]
    numbers, train = {}, Counter()
    want = [[numbers.setdefault(w, len(numbers)) for w in tokens(t)] for t in made]
    for w, h in zip(want, held):
        train.update([] if h else w)
    for cuts in ((0, len(made)), (0, 2, 3, 9, len(made))):
        block = mixing.Block(0)
        got = [x.tolist() for a, b in zip(cuts, cuts[1:]) for x in block.add(pa.array(made).slice(a, b - a), held[a:b])]
        assert got == want == [x.tolist() for x in block.texts] and block.held == held
        assert list(block.words) == list(numbers) and block.train[: len(numbers)].tolist() == [train[k] for k in range(len(numbers))]


def test_ordered():
    rng = np.random.default_rng(7)
    for n, high in ((0, 1), (1, 1), (2, 1), (999, 3), (5000, 1 << 40)):
        values = rng.integers(0, high, n).astype(np.uint64) << np.uint64(24) | rng.integers(0, 3, n).astype(np.uint64)
        assert mixing.ordered(values).tolist() == np.argsort(values, kind="stable").tolist()


def test_next_tokens_are_a_distribution(learnt):
    model, parts = learnt
    size = model.code.size
    for ids, one, other, _, n, _ in [p for p in parts if len(p[0]) > 5][:5]:
        for cut in (0, 1, 4, n - 1):
            total = 0.0
            for s in range(size):
                told = [np.append(f[:cut], t).astype(np.uint16) for f, t in ((one, 3), (other, NOTHING))]
                text = np.append(ids[:cut], s).astype(np.uint16)
                full, _ = model.log10(g := Group([(text, *told, 0, cut + 1, False)], size), np.zeros(len(g.escapes)))
                start, _ = model.log10(g := Group([(text[:cut], *[f[:cut] for f in told], 0, cut, False)], size), np.zeros(len(g.escapes))) if cut else ([0.0], None)
                total += 10 ** (full[0] - start[0])
            # What is foretold could be spelled too; that share is lost, and nothing is counted twice.
            text, told = np.append(ids[:cut], 3).astype(np.uint16), [np.append(f[:cut], NOTHING).astype(np.uint16) for f in (one, other)]
            spelled, _ = model.log10(g := Group([(text, *told, 0, cut + 1, False)], size), np.zeros(len(g.escapes)))
            assert 1 - 10 ** (spelled[0] - start[0]) - 1e-3 < total < 1 + 1e-3


def test_followers():
    numbers = [np.array([1, 2, 3, 1, 2, 4, 1, 2, 0]), np.array([5]), np.empty(0, np.int64), np.array([1, 2, 1, 2])]
    texts = Texts(numbers, np.arange(1, 7).astype(np.uint64))
    assert texts.words.tolist() == [1, 2, 3, 1, 2, 4, 1, 2, 0, 6, 5, 6, 6, 1, 2, 1, 2, 6]
    assert texts.after_last().tolist() == [-1, -1, -1, -1, -1, 2, -1, -1, 5, -1, -1, -1, -1, -1, -1, -1, -1, 15]
    rng = np.random.default_rng(0)
    long = rng.integers(0, 3000, 4000)
    texts = Texts([long, np.concatenate((long[100:], long[:7]))], rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    at, key = texts.anchors()
    assert len(at) > 300 and texts.place[at].min() >= mixing.BEFORE
    by_place = dict(zip(at.tolist(), key.tolist()))
    again = {a for a in by_place if 4001 + mixing.BEFORE <= a <= 4001 + 3900}
    assert again == {a + 3901 for a in by_place if 100 + mixing.BEFORE <= a <= 4000} and all(by_place[a] == by_place[a - 3901] for a in again)
    after = texts.following(at)
    words = mixing.short(texts.hashes)
    for a, row in zip(at.tolist(), after.tolist()):
        left = int(texts.ends[texts.doc[a]]) - a
        assert row == (words[a : a + min(left, mixing.NEXT)].tolist() + [0] * mixing.NEXT)[: mixing.NEXT]


def test_leading():
    rng = np.random.default_rng(2)
    key, doc_of, train = rng.integers(0, 9, 80).astype(np.uint64), rng.integers(0, 5, 80), rng.random(80) < 0.5
    keys, first, second = leading(key, doc_of, train)
    for k, a, b in zip(keys, first, second):
        own = [i for i in range(80) if key[i] == k and train[i]]
        assert (a in own and doc_of[a] == min(doc_of[own])) if own else a == -1
        others = {doc_of[i] for i in own} - ({doc_of[a]} if own else set())
        assert (b in own and doc_of[b] != doc_of[a]) if others else b == -1


def test_answers(spark):
    rows = [(1, 10, b"a"), (1, 11, None), (1, 12, b"c"), (2, 10, b"d"), (3, 10, None), (3, 11, None), (4, 12, b"e"), (4, 11, None)]
    got = mixing.answers(spark.createDataFrame(rows, "key long, block long, next binary")).collect()
    assert sorted((r.key, r.block, bytes(r.next)) for r in got) == [(1, 10, b"c"), (1, 11, b"a"), (1, 12, b"a"), (4, 11, b"e")]


def corpus(n):
    rng = random.Random(3)
    common = {lang: ["".join(rng.choices(parts, k=3)) for _ in range(60)] for lang, parts in (("aa", ["th", "er", "on", "an"]), ("bb", ["ko", "li", "mu", "sa"]))}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        words = [rng.choice(common[lang]) for _ in range(rng.randrange(5, 60))]
        words = [w.upper() if rng.random() < 0.1 else w + rng.choice(words) if rng.random() < 0.02 else w for w in words]
        rows.append(doc(i, " ".join(words), rng.choice([lang, lang, None])))
    return rows


def test_against_plain_counts(spark, tables):
    rows = corpus(150) + [(1000 + (r[0] or 0), *r[1:]) for r in ODD]
    got = {(r.doc_id, r.n_tokens): r for r in op6_context_mixing(spark, tables(documents=(rows, DOCS))).collect()}
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    counts = Counter(w for r in train for w in tokens(r[1]))
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1
    gain = 0.0
    for i, text, *_ in rows:
        w = tokens(text)
        r = got[i, len(w) + 1]
        c = [counts[x] for x in w] + [len(train)]
        assert (r.held_out, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, sum(x > 0 for x in c), total)
        want = sum(math.log10((x + 0.1) / (total + 0.1 * (distinct + 1))) for x in c)
        assert abs(r.base_score - want) < 1e-6 * max(1, abs(want))
        assert r.score < 0 and r.bits_per_byte > 0
        gain += (r.score - r.base_score) * (r.held_out and i < 1000)
    assert gain > 0


def test_what_is_learnt_from_the_corpus(spark, tables, monkeypatch):
    """Texts that occur twice are foretold by each other, in one block or in two; order matters; lang doesn't."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    made = [" ".join(rng.choices(words, k=150)) for _ in range(120)]
    rows = [doc(i, t) for i, t in enumerate(made)] + [doc(500 + i, made[i]) for i in range(20)]
    rows += [doc(700, " ".join(rng.sample(made[1].split(), 150)))]
    d = tables(documents=(rows, DOCS))
    found = []
    for size in (12 << 20, 20_000):
        monkeypatch.setattr(mixing, "TEXT_IN_BLOCK", size)
        found.append({r.doc_id: r.bits_per_byte for r in op6_context_mixing(spark, d).collect()})
    for got in found:
        train = [i for i in (*range(20), *range(500, 520)) if zlib.crc32(str(i % 500).encode()) % 10 and zlib.crc32(str(i % 500 + 500).encode()) % 10]
        assert len(train) > 20
        assert max(got[i] for i in train) < 0.8 * min(got[i] for i in range(20, 120))
        assert got[700] > 2 * got[1]
    changed = [(*r[:2], rng.choice("xyz"), rng.choice("pq"), *r[4:]) for r in rows]
    again = {r.doc_id: r.bits_per_byte for r in op6_context_mixing(spark, tables(documents=(changed, DOCS))).collect()}
    assert all(abs(again[i] - x) < 1e-6 for i, x in found[1].items())


def test_weights_are_learnt_on_all_training_texts(spark, tables, monkeypatch):
    """The last tables count every bit of the training texts and of their words, however small a sample might be."""
    monkeypatch.setattr(mixing, "LEARNT", 300, raising=False)
    monkeypatch.setattr(mixing, "WORDS", 10, raising=False)
    monkeypatch.setattr(mixing, "VOCABULARY", 50)
    found, train, spell = {}, mixing.train, mixing.spelling.train_mixer
    monkeypatch.setattr(mixing, "train", lambda ready, model, *more: found.setdefault("model", (ready, train(ready, model, *more)))[1])
    monkeypatch.setattr(mixing.spelling, "train_mixer", lambda words, counts: found.setdefault("mixer", spell(words, counts)))
    rows = corpus(60)
    mixing.score_documents(tables_of(spark, tables, rows), mixing.fold("doc_id", 10) == 0).collect()
    ready, model = found["model"]
    bits = 0
    for g, _, _ in mixing.groups(pa.RecordBatch.from_arrays([c.combine_chunks() for c in ready.toArrow().columns], names=ready.columns), model.code.size, True):
        bits += sum(len(on) for _, on, _, _ in g.levels(model.code, 0, g.n))
    assert int(model.cells.sum()) == bits > 0
    words = {w for r in rows if zlib.crc32(str(r[0]).encode()) % 10 for w in tokens(r[1])}
    assert int(found["mixer"].cells.sum()) == 8 * sum(len(w) + 1 for w in words)


def tables_of(spark, tables, rows):
    return spark.read.parquet(f"{tables(documents=(rows, DOCS))}/documents.parquet")


def test_nothing_to_learn(spark, tables):
    assert op6_context_mixing(spark, tables(documents=([], DOCS))).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = op6_context_mixing(spark, tables(documents=([doc(held, "some words")], DOCS))).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score < 0
