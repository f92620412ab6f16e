import numpy as np

from cloakframe.llm import spelling
from cloakframe.llm.spelling import CELLS, GATES, SLOTS, Mixer, Spelled, add_counts


def test_bits_spell_the_words():
    words = [b"the", b"", "é".encode(), b"abcdefgh"]
    s = Spelled(words)
    value = np.zeros(len(s.byte), np.int64)
    for _, slots, bits in s.bits():
        value = 2 * value + bits
        assert slots.min() >= 0 and slots.max() < SLOTS
    assert bytes(value.astype(np.uint8)) == b" ".join(words) + b" "


def test_contexts_are_the_words_own():
    """A word's slots don't depend on the words beside it."""
    both, one = Spelled([b"abc", b"xyz", b"abc"]), Spelled([b"abc"])
    for (_, a, _), (_, b, _) in zip(both.bits(), one.bits()):
        assert (a[:, :4] == b).all() and (a[:, 8:] == b).all()


def test_spellings_are_a_distribution():
    """The next byte's probabilities add up to one, whatever was learnt."""
    rng = np.random.default_rng(0)
    counts = np.zeros((2, SLOTS), np.float32)
    words = [b"".join(rng.choice([b"th", b"er", b"on", b"a"], 3)) for _ in range(300)]
    add_counts(words, counts)
    mixer = Mixer()
    mixer.learn(words, counts)
    assert mixer.cells.shape == (2, GATES * CELLS) and np.isfinite(mixer.w).all()
    before = mixer.log10([b"th"], counts)[0]
    ends = mixer.log10([b"th" + bytes([b]) for b in range(256) if b != 32], counts)
    # All these words begin with the same bytes, so together they are no likelier than those bytes.
    assert sum(10.0**x for x in [before, *ends]) <= 10.0 ** first_bytes(mixer, counts, b"th") + 1e-9


def first_bytes(mixer, counts, word):
    """log10 of the probability that a word begins with these bytes: its spelling without the end's bits."""
    centre = spelling.squash((np.arange(CELLS) - CELLS // 2) / 2)
    n0, n1 = mixer.cells.reshape(2, GATES, CELLS)
    refined = ((n1 + 50 * centre) / (n0 + n1 + 50)).ravel()
    total = 0.0
    for place, slots, bits in Spelled([word]).bits():
        x, gate = spelling.inputs(counts, slots, bits, place, False)
        t = np.einsum("ij,ji->j", x, mixer.w[gate])
        p = np.clip((spelling.squash(t) + refined[gate * CELLS + spelling._cell(t)]) / 2, 1e-7, 1 - 1e-7)
        total += float(np.log10(np.where(bits == 1, p, 1 - p))[:-1].sum())
    return total


def test_own_count_is_left_out():
    counts = np.zeros((2, SLOTS), np.float32)
    add_counts([b"alone"], counts)
    mixer, none = Mixer(), np.zeros((2, SLOTS), np.float32)
    assert abs(mixer.log10([b"alone"], counts, True)[0] - mixer.log10([b"alone"], none)[0]) < 1e-6
    assert mixer.log10([b"alone"], counts)[0] > mixer.log10([b"alone"], none)[0]


def test_log_odds_are_looked_up():
    """Log odds and gates are those of the counts, with and without a word's own bits."""
    words = [bytes([97 + k % 5, 98 + k % 7]) * (k % 4 + 1) for k in range(60)]
    counts = np.zeros((2, SLOTS), np.uint32)
    add_counts(words, counts)
    for out in (False, True):
        odds = spelling.LogOdds(counts, out)
        for place, slots, bits in Spelled(words).bits():
            n0, n1 = (counts[b].astype(int)[slots] - (out & (bits == b)) for b in (0, 1))
            x, gate = odds.inputs(slots, bits, place)
            assert np.allclose(x, np.log((n1 + spelling.PRIOR) / (n0 + spelling.PRIOR)), atol=1e-5)
            assert gate.tolist() == (place * spelling.SEEN + np.minimum(np.log2(n0[-1] + n1[-1] + 1), spelling.SEEN - 1).astype(int)).tolist()
