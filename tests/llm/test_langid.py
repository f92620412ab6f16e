import math
import random

import numpy as np
import pytest

from cloakframe.llm.langid import Pieces, blocks, expected, op1_language_id, pieces, vocabulary, word_scores
from helpers import DOCS, ODD, doc

SYLLABLES = {"xx": ["ka", "lo", "mi", "tar", "sel"], "yy": ["ungh", "isch", "ver", "zwo", "pf"]}


def slow(word, p, ids):
    """The sum over all segmentations, with its logarithm carried so that it doesn't underflow."""
    a, log = [1.0] + [0.0] * len(word), 0.0
    longest = max(map(len, ids))
    for i in range(1, len(word) + 1):
        for k in range(1, min(longest, i) + 1):
            if word[i - k : i] in ids:
                a[i] += a[i - k] * p[ids[word[i - k : i]]]
        if a[i] < 1e-100:
            log -= math.log(1e100)
            a[: i + 1] = [0.0] * max(0, i - longest) + [x * 1e100 for x in a[max(0, i - longest) : i + 1]]
    return math.log(a[-1]) + log


@pytest.fixture(scope="module")
def model():
    t = pieces(vocabulary())
    p = np.random.default_rng(1).random((t.n + 1, 2)) ** 4
    p[0] = 0
    return t, p / p.sum(axis=0), {x: k + 1 for k, x in enumerate(t.pieces)}


WORDS = [b" the", b" hello", " été".encode(), b" " + b"a" * 31, b" abcdefghijklmnopqrstuvwxy", b" "]


def test_forward_sums_all_segmentations(model):
    t, p, ids = model
    got = word_scores(WORDS, t, p)
    assert all(abs(got[k, c] - slow(w, p[:, c], ids)) < 1e-9 for k, w in enumerate(WORDS) for c in range(2))


LONG = [b" " + x for x in ("donaudampfschifffahrtsgesellschaft".encode(), "自然言語処理".encode() * 3, "ภาษาไทย".encode() * 90, "東京都".encode() * 222, b"internationalisation" * 30, b"x" * 513, b"a" * 512)]


def test_words_of_any_length(model):
    t, p, ids = model
    assert t.longest > 10 and {len(x) for x in t.pieces} > set(range(1, 20))
    got = word_scores(LONG, t, p)
    want = np.array([[slow(w, p[:, c], ids) for c in range(2)] for w in LONG])
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6) and want.min() < -2000


def test_expected_counts_of_long_words(model):
    t, p, _ = model
    counts = expected(LONG, np.ones(len(LONG)), t, p[:, 0])
    width = np.array([0, *map(len, t.pieces)])
    assert abs((counts * width).sum() - sum(map(len, LONG))) < 1e-6


def test_pieces_of_words():
    assert [Pieces.wordlike(x) for x in (b" the", b"the", " été".encode(), b"\xe6\x97", b" ", b"  ", b"a1", b" 1", b"a b", b"!")] == [True] * 5 + [False] * 5


def test_expected_counts_are_derivatives(model):
    t, p, ids = model
    counts = expected(WORDS, np.arange(1.0, 7.0), t, p[:, 0])
    for piece in (b"the", b"a", b" ", b"aaaa"):
        moved = p.copy()
        moved[ids[piece], 0] *= 1 + 1e-6
        change = ((word_scores(WORDS, t, moved) - word_scores(WORDS, t, p))[:, 0] * np.arange(1.0, 7.0)).sum() / 1e-6
        assert abs(counts[ids[piece]] - change) < 1e-4


def test_blocks_cover():
    assert sorted(k for places, _ in blocks(WORDS) for k in places) == list(range(len(WORDS)))


def made(n):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = ("xx", "yy")[i % 2]
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(3, 40)))
        rows.append(doc(i, text.upper() if i % 7 == 0 else text, lang))
    return rows


def test_held_out_accuracy(spark, tables):
    rows = made(120) + [doc(900, None), doc(901, "123 ... !"), doc(902, ""), (None, "kalomi tar", None, None, None, None), doc(903, "² ½"), doc(904, "ka" * 30000, "xx")]
    got = {r.doc_id: r for r in op1_language_id(spark, tables(documents=(rows, DOCS))).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:120] if got[r[0]].held_out)
    assert sum(got[i].held_out for i in range(120)) > 20
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902, 903))
    assert got[None].held_out is False and got[None].lang_pred == "xx" and got[904].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(spark, tables):
    assert op1_language_id(spark, tables(documents=([], DOCS))).collect() == []
    rows = [(i, r[1], None, *r[3:]) for i, r in enumerate(ODD)]
    assert {(r.lang_pred, r.score) for r in op1_language_id(spark, tables(documents=(rows, DOCS))).collect()} == {("und", 0.0)}
