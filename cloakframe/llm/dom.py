"""A forgiving HTML parser: elements and text in page order, for any input."""

from __future__ import annotations

import re
from html import unescape

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Fixed values of HTML: elements without an end, elements whose content is no text of the page,
#: elements whose content is text without markup, elements that begin a block of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style".split())
PLAIN = set("textarea title xmp".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_CLOSES_P = BLOCK - set("body button caption head html legend optgroup option tbody td textarea tfoot th thead title tr".split())
#: What a start tag ends, and the elements that it doesn't look beyond.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"})}
_SCOPE = {"table", "td", "th", "caption", "button", "html"}


class Page:
    """Nodes in page order; a node's parent comes before it. Text has tag '' and its decoded text."""

    def __init__(self) -> None:
        self.tag, self.parent, self.text, self.marks = ["#page"], [-1], [""], [""]

    def add(self, tag: str, parent: int, text: str = "", marks: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.marks.append(marks)
        return len(self.tag) - 1


def parse(html: str | None) -> Page:
    """The page's nodes. marks: the words of an element's class, id and role, in lower case."""
    page, stack, at = Page(), [0], 0
    html = html or ""
    tags = page.tag

    def words(text: str) -> None:
        if text:
            page.add("", stack[-1], unescape(text))

    def close(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if tags[stack[k]] in names:
                del stack[k:]
                return
            if tags[stack[k]] in stop:
                return

    while at < len(html):
        m = _TAG.search(html, at)
        if not m:
            words(html[at:])
            break
        words(html[at : m.start()])
        at = m.end()
        if not m[1]:
            continue
        name = m[1].lower()
        if html[m.start() + 1] == "/":
            if name == "p" or name not in VOID:
                close({name}, {"table"} if name not in ("table", "body", "html") and name in BLOCK else set())
            elif name == "br":
                page.add("br", stack[-1])
            continue
        marks = ""
        if m[2]:
            found = [a[1] or a[2] or a[3] for a in _ATTRIBUTE.findall(m[2]) if a[0].lower() in ("class", "id", "role")]
            hidden = [a[0].lower() for a in _ATTRIBUTE.findall(m[2]) if a[0].lower() == "hidden"]
            marks = " ".join(found + hidden).lower()
        if name in _CLOSES_P:
            close({"p"}, _SCOPE)
        if name in _ENDS:
            close(*_ENDS[name])
        node = page.add(name, stack[-1], "", marks)
        if name in RAW or name in PLAIN:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            if name in PLAIN and (inner := html[at : end.start() if end else len(html)]):
                page.add("", node, inner if name == "xmp" else unescape(inner))
            at = end.end() if end else len(html)
        elif name not in VOID:
            stack.append(node)
    return page


def joined(page: Page, kept: list[bool]) -> str:
    """The kept text: white space within a block as one space, blocks joined by one space."""
    blocks: list[str] = []
    run: list[str] = []
    n = len(page.tag)
    inside, order = [0] * n, []  # the nearest block around each node
    for k in range(1, n):
        up = page.parent[k]
        inside[k] = k if page.tag[k] in BLOCK else inside[up]
        if page.tag[k] == "" and kept[k]:
            order.append((inside[k], page.text[k]))
        elif page.tag[k] == "br":
            order.append((inside[k], " "))
        elif page.tag[k] in BLOCK:
            order.append((-1, ""))
    now = None
    for block, text in order:
        if block != now:
            blocks.append("".join(run))
            run, now = [], block
        run.append(text)
    blocks.append("".join(run))
    return " ".join(x for b in blocks if (x := " ".join(b.split())))
