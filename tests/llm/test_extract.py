import itertools
import math
import random

from hypothesis import given
from hypothesis import strategies as st

from cloakframe.llm.dom import Page, joined, parse
from cloakframe.llm.extract import classify, labelled_pages, main_text, marginals, op10_dom_marginals, trained

PAGES = "page_id long, url string, html string, text string"


def test_marginals_against_enumeration():
    rng = random.Random(1)
    for n in (1, 2, 5, 8):
        page = Page()
        for k in range(1, n):
            page.add("div", rng.randrange(k))
        kinds = ["root"] + [rng.choice(("text", "block")) for _ in range(n - 1)]
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        w = {f"edge:{k}:{x}": rng.uniform(-1, 1) for k in ("text", "block") for x in ("00", "01", "10", "11")}
        got, joint = marginals(page, unary, kinds, w)
        total, on, both = 0.0, [0.0] * n, [[0.0] * 4 for _ in range(n)]
        for state in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(u * s for u, s in zip(unary, state)) + sum(w[f"edge:{kinds[k]}:{state[page.parent[k]]}{state[k]}"] for k in range(1, n)))
            total += p
            for k in range(n):
                on[k] += p * state[k]
                if k:
                    both[k][2 * state[page.parent[k]] + state[k]] += p
        assert all(abs(a - b / total) < 1e-9 for a, b in zip(got, on))
        assert all(abs(joint[k][x] - both[k][x] / total) < 1e-9 for k in range(1, n) for x in range(4))


@given(st.text(alphabet="<>/!-p div&amp;\"'= x\n\x00", max_size=80))
def test_any_input_makes_a_tree(html):
    page = parse(html)
    assert all(0 <= page.parent[k] < k for k in range(1, len(page.tag)))
    joined(page, [True] * len(page.tag))


def whole(html):
    page = parse(html)
    return joined(page, [True] * len(page.tag))


def test_text():
    assert whole("<p>a  b<br>c<b>d</b>e\n<p>f&amp;g &lt;x&gt; &#233; &am") == "a b cde f&g <x> é &am"
    assert whole("<div>a<p>b</p>c</div><ul><li>d<li>e</ul>") == "a b c d e"
    assert whole("a < b<script>x</script><style>y</style><!-- z -->c <foot") == "a < bc"
    assert whole(None) == whole("") == ""


def test_labelled_pages():
    w = trained()
    seen = wrong = 0
    for page, label in labelled_pages(60, seed=1234):
        got = classify(page, w)
        for k in range(len(label)):
            if page.tag[k] == "" and page.text[k].strip():
                seen += 1
                wrong += got[k] != label[k]
    assert wrong / seen < 0.03


BODY = "<h1>A title</h1><p>First paragraph of the text, with some words.</p><p>Second one, &quot;quoted&quot; and <b>bold</b>.</p>"
TEXT = 'A title First paragraph of the text, with some words. Second one, "quoted" and bold.'


def test_query(spark, tables):
    html = f"""<html><head><title>T</title></head><body><div class="cookie-notice">We use cookies</div><nav><a href=/>Home</a></nav><header class="site-header"><p>Site</p></header>
    <article>{BODY}</article><div class="ad">Buy now</div><aside class="sidebar"><ul><li><a href=x>More</a></ul></aside>
    <section class="comments"><p>I like it</p></section><form><label>Name</label><button>Send</button></form><footer>&copy; me</footer></body></html>"""
    rows = [(1, "u", html, "clash"), (2, None, None, None), (3, "u", "", None), (4, "u", f"<article>{BODY}", None), (None, "u", html, None), (1, "u", html, "clash"), (5, "u", "<article>" + "<h1>word</h1>" + ("<p>" + "word " * 700) * 30, None)]
    got = sorted((tuple(r) for r in op10_dom_marginals(spark, tables(pages=(rows, PAGES))).collect()), key=str)
    long = " ".join(["word"] * 21001)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "u", "", 0), (4, "u", TEXT, len(TEXT)), (None, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (5, "u", long, len(long))], key=str)
    assert main_text(html, trained()) == TEXT
    assert op10_dom_marginals(spark, tables(pages=([], PAGES))).collect() == []


def test_text_of_other_elements():
    inner = "<noscript><p>Inside there is text of the article, some words long.</p></noscript><object><p>And here is more of its text, as before.</p></object><template><p>Some words to end it, and no more than that.</p></template>"
    assert main_text(f"<body><article><h1>Title</h1><p>The beginning of the article is here.</p>{inner}</article></body>", trained()) == "Title The beginning of the article is here. Inside there is text of the article, some words long. And here is more of its text, as before. Some words to end it, and no more than that."
    assert whole("<xmp>a <b>&amp;</b></xmp>") == "a <b>&amp;</b>" and whole("<iframe>c &amp; d</iframe>") == "c & d"


def test_many_short_paragraphs():
    words = [f"word{i}" for i in range(5000)]
    html = "<body><nav><a href=/>Home</a> <a href=/x>About</a></nav><div><h1>Title here</h1>" + "".join(f"<p>{w}</p>" for w in words) + "</div><footer>&copy; me</footer></body>"
    assert main_text(html, trained()) == "Title here " + " ".join(words)
