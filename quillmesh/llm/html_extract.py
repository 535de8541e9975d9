"""Main content of web pages by tree scoring.

A page is tokenised into tags, comments and text; script, style and similar elements are
skipped with all that is in them, unclosed paragraphs, list items and table cells end
where HTML ends them, and what remains is a tree.  Each paragraph-like element with at
least ``MIN_CHARS`` characters of text gets 1 point, 1 for each comma and 1 for each 100
characters (at most 3); its container gets all of them, the container's container half,
the next a third.  A container's points are multiplied by 1 - link density, the share of
its text that lies in links.  The best container is kept together with its siblings that
score at least a fifth of it (10 at least) and with sibling paragraphs that are long or
hold a sentence and have few links.

The text of what is kept is in document order; block elements and line breaks end a line,
white space is collapsed, entities are resolved.

Defined cases: null page_id: kept with a null id, as each row is judged by itself.  Null
html: null text, score 0.  Empty html, or a page without paragraphs: all visible text of
the page outside links' containers (nav, header, footer, aside) with score 0.  Ties
between containers: the first in the document.  Repeated rows: each.  Unclosed or stray
tags: as described; an unclosed comment, script or tag runs to the end of the page.  Very
long or deeply nested pages: read whole, in time in proportion to their length.  Extra
columns: ignored.  Empty table: no rows.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm.common import project, table

MIN_CHARS = 25
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*+(?:(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))[^>\"']*+)*+)(?:>|\Z)", re.S)
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "object"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
PARAGRAPH = {"p", "pre", "td", "blockquote"}
BOILERPLATE = {"nav", "header", "footer", "aside"}
#: An opening tag closes these open elements, up to one of its own scope.
CLOSES = {"li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
UNLIKELY = re.compile(r"\b(ad|ads|advert|banner|comment|footer|menu|nav|promo|related|share|sidebar|social|sponsor)\b", re.I)
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…](\s|$)")


class Node:
    __slots__ = ("tag", "parent", "children", "score", "unlikely", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None, unlikely: bool = False):
        self.tag, self.parent, self.unlikely = tag, parent, unlikely
        self.children: list[Node | str] = []
        self.score: float | None = None
        self.chars = self.linked = self.commas = 0


class Open:
    """The open elements, with their depths by tag, so that what a tag closes is found without walking up."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """Depth of the innermost open element of this tag, 0 without one."""
        depths = self.depths.get(tag)
        return depths[-1] if depths else 0

    def first_below(self, tag: str, depth: int) -> int:
        """Depth of the outermost open element of this tag that is deeper than ``depth``, 0 without one."""
        depths = self.depths.get(tag, ())
        k = bisect.bisect_right(depths, depth)
        return depths[k] if k < len(depths) else 0

    def close(self, depth: int) -> None:
        """The element at this depth and all within it."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()


def parse(page: str) -> Node:
    root = Node("html", None)
    at, end = 0, len(page)
    opened = Open(root)

    def text(raw: str) -> None:
        if raw:
            opened.stack[-1].children.append(entities.unescape(raw) if "&" in raw else raw)

    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        name = found.group(2)
        if not name:
            if page.startswith("<![CDATA[", found.start()):
                opened.stack[-1].children.append(page[found.start() + 9 : at - 3 if page.endswith("]]>", 0, at) else at])
            continue
        tag = name.lower()
        if found.group(1):
            if depth := opened.last(tag):
                opened.close(depth)
            continue
        if tag in ("html", "body", "head"):
            continue
        if tag in BLOCK and opened.stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in CLOSES:
            closing, scope = CLOSES[tag]
            limit = max(opened.last(t) for t in scope)
            ends = [d for d in (opened.first_below(t, limit) for t in closing) if d]
            if ends:
                opened.close(min(ends))
        child = Node(tag, opened.stack[-1], bool(UNLIKELY.search(found.group(3))) if "=" in found.group(3) else False)
        opened.stack[-1].children.append(child)
        closed = tag in VOID or found.group(3).endswith("/")
        if tag in RAW and not closed:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                child.children.append(entities.unescape(page[at : stop.start() if stop else end]))
            at = stop.end() if stop else end
        elif not closed:
            opened.push(child)
    return root


def _walk(root: Node) -> list[Node]:
    """Elements in document order, without skipped ones."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in SKIPPED and c.tag != "title")
    return out


def _measure(nodes: list[Node]) -> None:
    """Visible characters, white space collapsed, and those in links; commas.  From the leaves up, each node once."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
                node.commas += c.count(",")
            elif c.tag not in SKIPPED and c.tag != "title":
                node.chars += c.chars
                node.linked += c.linked
                node.commas += c.commas
        if node.tag == "a":
            node.linked = node.chars


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def render(nodes: list[Node], skip: set[int] = frozenset()) -> str:
    """Text of the elements, one line a block."""
    pieces: list[str] = []
    stack: list[Node | str] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            pieces.append(item if item == "\n" else _SPACE.sub(" ", item))
        elif item.tag == "br":
            pieces.append("\n")
        elif item.tag not in SKIPPED and item.tag != "title" and id(item) not in skip:
            ends = item.tag in BLOCK
            if ends:
                pieces.append("\n")
                stack.append("\n")
            stack.extend(reversed(item.children))
    lines = (_SPACE.sub(" ", line).strip() for line in "".join(pieces).split("\n"))
    return "\n".join(line for line in lines if line)


def _inner(node: Node) -> str:
    return render([node])


def extract(page: str) -> tuple[str, float]:
    """(text, score of the best container)."""
    root = parse(page)
    nodes = _walk(root)
    _measure(nodes)
    order = {id(n): k for k, n in enumerate(nodes)}
    candidates: dict[int, Node] = {}
    for node in nodes:
        if node.tag not in PARAGRAPH or node.chars < MIN_CHARS or node.parent is None:
            continue
        points = 1 + node.commas + min(3, node.chars // 100)
        above, share = node.parent, 1
        while above is not None and share <= 3:
            if above.score is None:
                above.score = (-25.0 if above.unlikely else 0.0) + (5.0 if above.tag in ("article", "main") else 0.0)
                candidates[id(above)] = above
            above.score += points / share
            above, share = above.parent, share + 1
    if not candidates:
        skip = {id(n) for n in nodes if n.tag in BOILERPLATE or n.unlikely}
        return render([root], skip), 0.0
    final = {k: n.score * (1 - _density(n)) for k, n in candidates.items()}
    best = candidates[max(final, key=lambda k: (final[k], -order[k]))]
    top = final[id(best)]
    if best.parent is None:
        return render([best], {id(n) for n in nodes if n.tag in BOILERPLATE or n.unlikely}), round(top, 6)
    kept = []
    for sibling in best.parent.children:
        if isinstance(sibling, str) or sibling.tag in SKIPPED:
            continue
        if sibling is best or final.get(id(sibling), -1.0) >= max(10.0, top * 0.2):
            kept.append(sibling)
        elif sibling.tag == "p" and not sibling.unlikely:
            if sibling.chars > 80 and _density(sibling) < 0.25 or 0 < sibling.chars <= 80 and not sibling.linked and _SENTENCE.search(_inner(sibling)):
                kept.append(sibling)
    return render(kept), round(top, 6)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, score, n_chars) for each row."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extract(h) if isinstance(h, str) else (None, 0.0) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": [t for t, _ in found], "score": np.array([s for _, s in found], np.float64), "n_chars": np.array([len(t or "") for t, _ in found], np.int64)})

    rows = project(pages, page_id=("page_id", "long"), url=("url", "string"), html=("html", "string"))
    return rows.mapInPandas(look, "page_id long, url string, text string, score double, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
