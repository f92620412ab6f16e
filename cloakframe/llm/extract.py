"""Operator 10: main text of pages by a tree-structured graphical model.

Every element and every run of text of a page is a variable, content or not. A node's potential
is log-linear in features of the node (its tag, its class words, how much of its text is in
links, its length and depth); a potential on each edge couples parent and child, by the child's
kind. Messages go up and then down the tree (sum-product), which gives every node's marginal; a
run of text is kept where content is likelier.

The weights are fitted by gradient ascent on the likelihood of labelled pages, whose marginals
come from the same message passing. The labelled pages are written by a generator from common
page layouts (labelled_pages), since no table labels pages; the fit takes PAGES of them and is the
same on every machine. Null html is an empty page; any bytes make some tree. White space is what
str.split() takes for it. Text of noscript, object, template and frames is text like any other.
Content as likely as not is none. Whole pages are read, however long; repeated rows are extracted
each, an empty table gives an empty one, and other columns of pages stay out of the result.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cloakframe.llm.common import prepare
from cloakframe.llm.dom import BLOCK, Page, joined, parse

PAGES = 400
ROUNDS = 14
RATE = 0.3
_WORD = re.compile(r"[a-z]+").findall

Weights = dict[str, float]


def features(page: Page) -> list[list[str]]:
    """Names of each node's features."""
    n = len(page.tag)
    size, linked, depth = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        up = page.parent[k]
        depth[k] = depth[up] + (page.tag[k] != "")
        in_link[k] = in_link[up] or page.tag[k] == "a"
        if page.tag[k] == "":
            size[k] = len(page.text[k])
            linked[k] = size[k] if in_link[k] else 0
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        linked[page.parent[k]] += linked[k]
    out = []
    for k in range(n):
        tag = page.tag[k]
        share = linked[k] / size[k] if size[k] else 0
        names = ["bias", f"size:{min(12, size[k].bit_length())}", f"linked:{int(share * 4)}"]
        if tag == "":
            names.append(f"text in {page.tag[page.parent[k]]}")
        else:
            names += [f"tag:{tag}", f"depth:{min(depth[k], 6)}"]
            if page.marks[k]:
                names += [f"mark:{w}" for w in set(_WORD(page.marks[k]))]
        out.append(names)
    return out


def edges(page: Page) -> list[str]:
    """The kind of each node's edge to its parent."""
    kinds = ["root"]
    for k in range(1, len(page.tag)):
        tag = page.tag[k]
        kinds.append("text" if tag == "" else "block" if tag in BLOCK else "inline")
    return kinds


def marginals(page: Page, unary: list[float], kinds: list[str], w: Weights) -> tuple[list[float], list[tuple[float, float, float, float]]]:
    """P(content) of each node, and each edge's joint probabilities (parent, child) as 00, 01, 10, 11.

    unary: log odds of each node's own potential. Messages are kept with sum one.
    """
    n = len(unary)
    psi = {kind: tuple(math.exp(w.get(f"edge:{kind}:{x}", 0.0)) for x in ("00", "01", "10", "11")) for kind in set(kinds)}
    own1 = [1 / (1 + math.exp(-max(-30.0, min(30.0, u)))) for u in unary]
    low0, low1 = [1 - x for x in own1], own1[:]  # own potential times the messages from below
    up0, up1 = [0.5] * n, [0.5] * n
    parent = page.parent
    for k in range(n - 1, 0, -1):
        a, b, c, d = psi[kinds[k]]
        m0, m1 = a * low0[k] + b * low1[k], c * low0[k] + d * low1[k]
        s = m0 + m1
        up0[k], up1[k] = m0 / s, m1 / s
        p = parent[k]
        x, y = low0[p] * up0[k], low1[p] * up1[k]
        s = x + y
        low0[p], low1[p] = x / s, y / s
    out, joint = [0.0] * n, [(0.0, 0.0, 0.0, 0.0)] * n
    all0, all1 = low0[:], low1[:]
    out[0] = low1[0]
    for k in range(1, n):
        p = parent[k]
        a, b, c, d = psi[kinds[k]]
        r0, r1 = all0[p] / max(up0[k], 1e-300), all1[p] / max(up1[k], 1e-300)
        s = r0 + r1
        r0, r1 = r0 / s, r1 / s
        j = (r0 * a * low0[k], r0 * b * low1[k], r1 * c * low0[k], r1 * d * low1[k])
        s = sum(j)
        joint[k] = j = (j[0] / s, j[1] / s, j[2] / s, j[3] / s)
        all0[k], all1[k] = j[0] + j[2], j[1] + j[3]
        out[k] = all1[k]
    return out, joint


def classify(page: Page, w: Weights) -> list[bool]:
    """Whether each node is content."""
    get = w.get
    unary = [sum([get(f, 0.0) for f in names]) for names in features(page)]
    return [p > 0.5 for p in marginals(page, unary, edges(page), w)[0]]


def fit(labelled: list[tuple[Page, list[bool]]], rounds: int = ROUNDS, rate: float = RATE) -> Weights:
    """Weights that make the labels likely; steps are scaled by each weight's past gradients."""
    w: Weights = {}
    past: dict[str, float] = {}
    ready = [(page, label, features(page), edges(page)) for page, label in labelled]
    for _ in range(rounds):
        for page, label, names, kinds in ready:
            unary = [sum(w.get(f, 0.0) for f in fs) for fs in names]
            p, joint = marginals(page, unary, kinds, w)
            step: dict[str, float] = {}
            for k in range(len(unary)):
                gap = label[k] - p[k]
                for f in names[k]:
                    step[f] = step.get(f, 0.0) + gap
                if k:
                    seen = 2 * label[page.parent[k]] + label[k]
                    for x in range(4):
                        key = f"edge:{kinds[k]}:{x >> 1}{x & 1}"
                        step[key] = step.get(key, 0.0) + (x == seen) - joint[k][x]
            for f, g in step.items():
                g -= 1e-3 * w.get(f, 0.0)
                past[f] = past.get(f, 1.0) + g * g
                w[f] = w.get(f, 0.0) + rate * g / math.sqrt(past[f])
    return w


#: Words of class, id and role attributes that the generator gives to each part of a page.
PARTS = {
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs tabs toc toolbar pagination pager skip links topnav",
    "header": "header masthead topbar banner site logo branding tagline hero",
    "footer": "footer copyright legal colophon bottom credits disclaimer",
    "sidebar": "sidebar aside related recommended widget popular trending archive complementary rail side secondary more tags categories",
    "notice": "notice cookie consent alert gdpr privacy warning message popup modal overlay newsletter subscribe subscription paywall toast announcement",
    "advert": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner dfp outbrain taboola commercial partner",
    "form": "form login search signup register contact newsletter",
    "comments": "comments comment replies reply disqus respond thread discussion responses reader feedback",
    "share": "share social sharing follow buttons twitter facebook",
}
ARTICLE = "article content post entry story main text body page single hentry blog news primary column container wrapper section paragraph lead intro summary"


def labelled_pages(n: int, seed: int = 7) -> list[tuple[Page, list[bool]]]:
    """Pages of common layouts. A node is content if most of its text is the article's."""
    rng = random.Random(seed)
    letters = "aabcdeeefghiilmnoooprrssttuvyéüñ"

    def prose(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randrange(1, 11))) + rng.choice(["", "", "", "", ",", ".", "!!", "***", "&amp;", " |"]) for _ in range(rng.randrange(low, high)))

    def mark(words: str) -> str:
        w = words.split()
        kind = rng.choice(("class", "class", "id", "role"))
        return f' {kind}="{rng.choice(("-", "_", " ")).join(rng.sample(w, min(len(w), rng.choice((1, 1, 2)))))}"' if rng.random() < 0.85 else ""

    def sometimes(x: str, p: float = 0.5) -> str:
        return x if rng.random() < p else ""

    def links() -> str:
        items = [f'<a href="/{k}">{prose(1, 4)}</a>' for k in range(rng.randrange(2, 8))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def paragraphs(low: int, high: int, size: int = 60) -> str:
        return "".join(f"<p>{prose(1, size)}{sometimes('</p>', 0.8)}" for _ in range(rng.randrange(low, high)))

    def noise(part: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(part)
        tag, marks = (tag, sometimes(mark(PARTS[part]))) if tag and rng.random() < 0.55 else (rng.choice(("div", "div", "section", "ul" if part in ("menu", "share") else "div")), " ")
        while marks == " " or (tag in ("section", "div", "ul") and not marks):
            marks = mark(PARTS[part])
        body = {
            "menu": links,
            "header": lambda: sometimes(f"<h1>{prose(1, 5)}</h1>", 0.4) + sometimes(f"<p>{prose(2, 9)}</p>") + sometimes(links()) + prose(1, 6),
            "footer": lambda: sometimes("&copy; ") + prose(1, 25) + sometimes(f"<p>{prose(2, 30)}</p>") + sometimes(links(), 0.4),
            "sidebar": lambda: sometimes(f"<h3>{prose(1, 4)}</h3>") + sometimes(links(), 0.6) + sometimes(paragraphs(1, 3, 40)) + prose(1, 30),
            "notice": lambda: rng.choice(("", "<p>")) + prose(3, 40) + sometimes(f"<button>{prose(1, 3)}</button>"),
            "advert": lambda: rng.choice(("", "<p>", "<a href='/x'>")) + prose(2, 40),
            "form": lambda: f"<label>{prose(1, 4)}</label><input name=q><select><option>{prose(1, 3)}<option>{prose(1, 3)}</select><textarea>{prose(1, 6)}</textarea><button>{prose(1, 3)}</button>" + sometimes(f"<p>{prose(2, 12)}</p>"),
            "comments": lambda: sometimes(f"<h2>{prose(1, 4)}</h2>") + "".join(rng.choice((f"<div{mark(PARTS['comments'])}><p>{prose(2, 50)}</p></div>", f"<p>{prose(2, 50)}</p>", f"<article{mark(PARTS['comments'])}><p>{prose(2, 40)}</p></article>")) for _ in range(rng.randrange(1, 6))),
            "share": lambda: " ".join(f'<a href="#">{prose(1, 3)}</a>' for _ in range(rng.randrange(1, 4))),
        }[part]()
        return f"<{tag}{marks}>{body}</{tag}>"

    out = []
    for _ in range(n):
        spots = {part: rng.random() < p for part, p in (("menu", 0.85), ("header", 0.5), ("footer", 0.85), ("sidebar", 0.5), ("notice", 0.4), ("advert", 0.6), ("form", 0.4), ("comments", 0.5), ("share", 0.4))}
        before = [noise(k) for k in ("header", "menu", "notice", "advert", "form") if spots[k] and rng.random() < 0.75]
        after = [noise(k) for k in ("sidebar", "form", "comments", "advert", "notice", "share", "menu", "footer") if spots[k]]
        inside = [noise(k) for k in ("advert", "share", "comments", "sidebar", "notice", "form", "menu", "header", "footer") if spots[k] and rng.random() < 0.25]
        body = [f"<h{rng.choice('112')}>{prose(1, 12)}</h1>"] * (rng.random() < 0.85)
        for _ in range(rng.choice((1, 1, 2, 4, 8))):
            body.append(
                rng.choice(
                    (
                        lambda: paragraphs(1, 4, rng.choice((4, 30, 120))),
                        lambda: paragraphs(1, 5, 200),
                        lambda: paragraphs(8, rng.choice((12, 90)), rng.choice((2, 3, 12, 60))),
                        lambda: f"<p><b>{prose(1, 30)}<br><p>{prose(1, 80)}</p>",
                        lambda: f"<p>{prose(1, 30)}<em>{prose(1, 4)}</em>, <a href='/y'>{prose(1, 5)}</a> {prose(1, 30)}</p>",
                        lambda: f"<{rng.choice(('h2', 'h3'))}>{prose(1, 6)}</h2>" + paragraphs(1, 3),
                        lambda: "<ul>" + "".join(f"<li>{prose(1, 14)}" for _ in range(rng.randrange(1, 6))) + "</ul>",
                        lambda: f"<blockquote{sometimes(' class=quote')}>{paragraphs(1, 2)}</blockquote>",
                        lambda: f"<table>{''.join(f'<tr><td>{prose(1, 5)}<td>{prose(1, 5)}' for _ in range(rng.randrange(1, 5)))}</table>",
                        lambda: f"<pre>{prose(1, 30)}</pre>",
                        lambda: f"<figure><img src=x><figcaption>{prose(1, 12)}</figcaption></figure>",
                        lambda: f"<div>{prose(1, 60)}</div>",
                    )
                )()
            )
        for x in inside:
            body.insert(rng.randrange(1, len(body) + 1) if body else 0, "\x01" + x + "\x02")
        main = "".join(body)
        for _ in range(rng.choice((0, 0, 1, 2))):
            main = f"<{(t := rng.choice(('div', 'section')))}{mark(ARTICLE)}>{main}</{t}>"
        main = f"<{(t := rng.choice(('article', 'article', 'article', 'main', 'div')))}{mark(ARTICLE) or (' class=content' if t == 'div' else '')}>{main}</{t}>"
        head = f"<head><title>{prose(1, 8)}</title><style>p{{}}</style><script>var a='</p>'</script></head>" if rng.random() < 0.9 else ""
        lines = rng.choice(("", "\n"))
        html = head + "<body>" + lines.join(before) + "<!-- x -->" + "\x03" + main + "\x04" + lines.join(after)
        if rng.random() < 0.3:
            html = f"<!DOCTYPE html><html><body><div{mark('wrapper page container site')}>{html}</div>"
        out.append(_labelled(html))
    return out


def _labelled(html: str) -> tuple[Page, list[bool]]:
    """Control characters bound the article (3, 4) and what doesn't belong to it within (1, 2)."""
    page = parse(html)
    n = len(page.tag)
    good, size, inside, out = [0] * n, [0] * n, False, 0
    for k in range(n):
        if page.tag[k] != "":
            continue
        kept = []
        for c in page.text[k]:
            if c == "\x03":
                inside = True
            elif c == "\x04":
                inside = False
            elif c == "\x01":
                out += 1
            elif c == "\x02":
                out -= 1
            else:
                kept.append((c, inside and not out))
        page.text[k] = "".join(c for c, _ in kept)
        size[k] = sum(not c.isspace() for c, _ in kept)
        good[k] = sum(ok for c, ok in kept if not c.isspace())
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        good[page.parent[k]] += good[k]
    label = [2 * good[k] > size[k] for k in range(n)]
    for k in range(1, n):  # an empty node goes with its parent; what holds the article is content
        if not size[k]:
            label[k] = label[page.parent[k]]
        elif page.tag[k] in ("body", "html"):
            label[k] = True
    label[0] = True
    return page, label


@cache
def trained() -> Weights:
    """The model; it's the same in every session, so a process fits it once."""
    return fit(labelled_pages(PAGES))


def main_text(html: str | None, w: Weights) -> str:
    page = parse(html)
    return joined(page, classify(page, w))


def extract(pages: DataFrame, keep: list[str], w: Weights) -> DataFrame:
    """pages' columns keep, with the html's main text and its length in code points."""
    fields = [f for f in pages.schema.fields if f.name in keep]
    schema = StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, w) for x in batch.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*[f"`{f.name}`" for f in fields], pages["html"].alias("__html")).mapInArrow(run, schema)


def op10_dom_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    prepare(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"], trained())
