import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cloakframe.llm.leaks import Matcher, budget, masks_of, myers, op9_edit_decontamination, plain
from helpers import DOCS, ODD, doc


def substring_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for at, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, (row[-1], at))
    return best


@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=30))
def test_myers(pattern, text):
    assert myers(masks_of(pattern), len(pattern), text) == substring_distance(pattern, text)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        k = rng.randrange(len(t))
        t[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [t[k], rng.choice("xyz")]])
    return "".join(t)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30))
def test_nothing_within_the_budget_is_missed(seed):
    rng = random.Random(seed)
    items = [(i, plain("".join(rng.choices("abcdef gh", k=rng.randrange(20, 90))))) for i in range(4)]
    items = [(i, t) for i, t in items if len(t) >= 20] or [(9, "abcdefgh abcdefgh abcdefgh")]
    text = plain("".join(rng.choices("abcdef gh", k=60)) + edited(rng, rng.choice(items)[1], rng.randrange(6)) + "".join(rng.choices("abcdef gh", k=60)))
    got = {x["item_id"]: x for x in Matcher(items).find(text)}
    for i, t in items:
        distance, _ = substring_distance(t, text)
        assert (i in got) == (distance <= budget(len(t)))
        if i in got:
            x = got[i]
            assert x["distance"] == distance and x["end"] - x["start"] <= len(t) + distance
            assert substring_distance(t, text[x["start"] : x["end"]])[0] == distance


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab 1é.", min_size=1, max_size=24), min_size=1, max_size=5), st.text(alphabet="ab 1é.", max_size=40))
def test_short_items_stand_as_whole_words(items, rest):
    items = [(i, plain(t)) for i, t in enumerate(items) if plain(t)]
    text = plain(rest + " " + "".join(t + " x" for _, t in items[:1]) + rest)
    inside = lambda a, b: 0 < a < len(text) and text[a - 1].isalnum() and text[a].isalnum() or 0 < b < len(text) and text[b - 1].isalnum() and text[b].isalnum()
    got = {x["item_id"]: x for x in Matcher(items).find(text)}
    for i, t in items:
        if budget(len(t)):
            assert (i in got) == (substring_distance(t, text)[0] <= budget(len(t)))
            continue
        places = [a for a in range(len(text) - len(t) + 1) if text[a : a + len(t)] == t and not inside(a, a + len(t))]
        assert ([(got[i]["distance"], got[i]["start"], got[i]["end"])] if i in got else []) == [(0, a, a + len(t)) for a in places[:1]]


def test_query(spark, tables):
    item = "The quick brown fox jumps over the lazy dog and then it sleeps until the morning comes again."
    other = "An entirely different passage that no document below has in any form whatsoever, we hope."
    rows = [*ODD, doc(50, "start " + item + " end"), doc(51, "x\n" + item.upper().replace(" ", "\n ")), doc(52, item.replace("brown", "brwn").replace("lazy", "laxy")), doc(53, item[:40])]
    bench = [(1, item), (2, other), (3, None), (4, ""), (5, "the"), (None, item), (6, item)]
    d = tables(documents=(rows, DOCS), benchmark=(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in op9_edit_decontamination(spark, d).collect()}
    assert set(got) == {(i, k) for i in (50, 51, 52) for k in (1, 6, None)} | {(i, 5) for i in (1, 6, 8, 50, 51, 52, 53)}
    assert [got[i, 1].distance for i in (50, 51, 52)] == [0, 0, 2]
    assert plain(rows[-4][1])[got[50, 1].start : got[50, 1].end] == plain(item)
    assert op9_edit_decontamination(spark, tables(documents=([], DOCS))).collect() == []


def test_blocks_of_items(spark, tables, monkeypatch):
    import cloakframe.llm.leaks as leaks

    monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
    items = [(i, f"item number {i} has some words of its own, namely {'abcdefghij'[i] * 5} and more") for i in range(10)]
    rows = [doc(i, "before " + t + " after " + items[i - 1][1]) for i, t in items]
    d = tables(documents=(rows, DOCS), benchmark=(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in op9_edit_decontamination(spark, d).filter("distance = 0").collect()}
    assert got == {(i, k) for i in range(10) for k in (i, (i - 1) % 10)}
