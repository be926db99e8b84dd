"""Main-text extraction by tree scoring."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"script", "style", "noscript", "template", "nav", "footer", "aside", "button", "select", "textarea", "iframe", "svg", "title", "object", "dialog", "menu"}
BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "table", "tr", "td", "th", "tbody", "thead", "div", "section", "article", "main", "body", "html", "header", "figure", "figcaption", "address", "hr"}
DIRECT = {"div", "section", "article", "main", "body"}
TEXTUAL = {"p", "pre", "blockquote", "td", "li", "dd"}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "li", "dt", "dd", "body", "html"} | {"ul", "ol"}
UNLIKELY = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|comments?|disqus|replies|sidebar|nav\w*|menu|footer|header|breadcrumbs?|share|social|related|newsletter|subscribe|widget|masthead)(?:$|[_-])", re.I)
#: Names of what is never the page's content as long as there is any other.
FOREIGN = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|popup|comments?|disqus|replies|breadcrumbs?|related|newsletter|subscribe)(?:$|[_-])", re.I)
#: A sibling with a larger share of its text in links is a list of links.
LINKS = 0.5
#: Text elements keep what they hold, whatever their name.
NAMED = BLOCK - {"html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "tr", "td", "th", "tbody", "thead", "figcaption", "hr"} | {"span"}
#: Names that say what else the page has, not what the element is.
ABOUT_PAGE = re.compile(r"(?:^|[_-])(?:with|without|has|no)[_-]", re.I)
HEADER = re.compile(r"(?:^|[_-])(?:header|masthead)(?:$|[_-])", re.I)
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "items", "score", "passed", "bad", "named", "foreign", "text_n", "link_n", "commas", "direct_n", "direct_commas")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False):
        self.tag, self.parent, self.bad = tag, parent, bad
        self.named = self.foreign = False  # marked only for its class, id or role, or as a form
        self.items: list[Node | str] = []
        self.score = self.passed = 0.0
        self.text_n = self.link_n = self.commas = self.direct_n = self.direct_commas = 0

    def points(self) -> float:
        """For a text element's whole text, or for the text that lies directly in a container."""
        n, commas = (self.text_n, self.commas) if self.tag in TEXTUAL else (self.direct_n, self.direct_commas) if self.tag in DIRECT else (0, 0)
        return 1 + commas + min(n / 100, 3) if n else 0.0


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None)
        self.depth = 0
        self.open: dict[str, int] = {}
        self.nodes = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.open.get("p"):
            self.end("p")
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and self.at.tag == tag:
            self.end(tag)
        inside = bool(self.open.get("article") or self.open.get("main"))
        node = Node(tag, self.at, tag in SKIP or tag == "header" and not inside)
        if tag == "form":
            node.named = True
        elif not node.bad and tag in NAMED:
            said = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v).split()
            said = [v for v in said if UNLIKELY.search(v) and not ABOUT_PAGE.search(v) and not (inside and HEADER.search(v))]
            node.named, node.foreign = bool(said), any(FOREIGN.search(v) for v in said)
        self.at.items.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("div", "p", "span", "a"):
            self.end(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.end(tag)

    def end(self, tag: str) -> None:
        if not self.open.get(tag):
            return
        while self.at.parent is not None:
            node, self.at = self.at, self.at.parent
            self.open[node.tag] -= 1
            if node.tag == tag:
                return

    def handle_data(self, data):
        self.at.items.append(data)


def blocks(node: Node) -> list[str]:
    """Texts between block borders, in page order, without marked subtrees."""
    out, run, stack = [], [], [node]
    while stack:
        x = stack.pop()
        if x is None:
            out.append("".join(run))
            run.clear()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.bad:
            border = x.tag in BLOCK
            stack.extend([None] * border)
            stack.extend(reversed(x.items))
            stack.extend([None] * border)
    out.append("".join(run))
    return [t for t in (WHITE.sub(" ", b).strip() for b in out) if t]


def measure(tree: Tree, left_out: set) -> None:
    """Lengths and commas of the text of every element, once from the leaves up, without the subtrees that are left out."""
    for node in tree.nodes:
        node.text_n = node.link_n = node.commas = node.direct_n = node.direct_commas = 0
    for node in reversed(tree.nodes):
        if node in left_out:
            continue
        for x in node.items:
            if isinstance(x, str):
                node.direct_n += len(WHITE.sub(" ", x).strip())
                node.direct_commas += x.count(",") + x.count("，")
        node.text_n += node.direct_n
        node.commas += node.direct_commas
        if node.tag == "a":
            node.link_n = node.text_n
        if node.parent is not None:
            node.parent.text_n += node.text_n
            node.parent.link_n += node.link_n
            node.parent.commas += node.commas


def mark(tree: Tree) -> None:
    """Marks the elements that their name says are no content, and all below marked ones.

    Comments, adverts and the like go wherever there is any other text. Another
    named element, or a form, stays if the page's only article or main is in it
    or, on a page without these, most of the points of the page's paragraphs.
    """
    foreign, rest = set(), False
    for node in tree.nodes:
        if node.foreign or node.parent in foreign:
            foreign.add(node)
    below, named = set(), set()  # of marked ones; of named ones
    for node in tree.nodes:
        if node.parent in below or node.bad:
            below.add(node)
        if node.named or node.parent in named:
            named.add(node)
    measure(tree, below | foreign)
    rest = tree.root.text_n > 0
    gone = below | foreign if rest else below
    if not rest:
        measure(tree, below)
    points, holds = dict.fromkeys(tree.nodes, 0.0), set()
    for node in reversed(tree.nodes):
        if node in gone:
            continue
        if node.tag in TEXTUAL:
            points[node] += node.points()
        if node.tag in ("article", "main"):
            holds.add(node)
        if node.parent is not None:
            points[node.parent] += points[node]
            if node in holds:
                holds.add(node.parent)
    outside = any(n.tag in ("article", "main") and n not in named for n in holds)
    for node in tree.nodes:
        if node.foreign and rest:
            node.named = True
        elif node.named and not outside:
            node.named = node not in holds and (bool(holds) or points[node] * 2 <= points[tree.root])
        node.bad |= node.named or node.parent is not None and node.parent.bad


def extract(html: str | None) -> str:
    """Article text: each paragraph passes points for its length and commas to
    its parent, half to the grandparent, a third of that to each further one; a
    link density discounts them, and an article or main scores a quarter more.
    If the best container lies in main, main is kept, else if in an article,
    this and its sibling articles; else the container and, on each level above
    it, all siblings but those with more than half of their text in links.
    Marked elements (see mark) are left out everywhere, nothing else is: no text
    is too short to stay. <br> is white space inside its block. Time is linear
    in the page, whatever the depth of its elements."""
    tree = Tree()
    tree.feed(html or "")
    HTMLParser.close(tree)
    mark(tree)
    measure(tree, {n for n in tree.nodes if n.bad})
    density = lambda n: n.link_n / n.text_n if n.text_n else 0.0
    for node in reversed(tree.nodes):
        if node.bad:
            continue
        own = node.points()
        if node.tag in TEXTUAL:
            to_parent, further = own, 0.0
        else:  # a container's own text counts for itself
            node.score += own
            to_parent, further = 0.0, own / 2
        if node.parent is not None:
            # score: what its paragraphs passed; passed: what they pass on from here.
            node.parent.score += to_parent + node.passed
            node.parent.passed += to_parent / 2 + further / 3 + node.passed / 3
            node.parent.score += further
    able = [n for n in tree.nodes if not n.bad and n.score > 0 and n.tag not in ("root", "a", "b", "i", "em", "strong", "span")]
    if not able:
        return "\n\n".join(blocks(tree.root))
    best = max(able, key=lambda n: n.score * (1 - density(n)) * (1.25 if n.tag in ("article", "main") else 1))
    article, up = None, best
    while up is not None and up.tag != "main":
        article = article or (up if up.tag == "article" else None)
        up = up.parent
    if up is not None:
        return "\n\n".join(blocks(up))
    if article is not None:
        kept = Node("div", None)
        kept.items = [x for x in article.parent.items if x is article or not isinstance(x, str) and not x.bad and x.tag == "article"]
        return "\n\n".join(blocks(kept))
    chain = {best}
    while best.parent is not None:
        best = best.parent
        chain.add(best)
    for node in chain:
        # What is not on the way to the best container leaves if it is a list of links.
        for x in node.items if any(c in chain for c in node.items if not isinstance(c, str)) else ():
            if not isinstance(x, str) and x not in chain and x.tag in BLOCK and density(x) > LINKS:
                x.bad = True
    return "\n\n".join(blocks(tree.root))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; null or empty html gives an empty text, an empty table none. Repeated rows stay, other columns are left out."""
    def run(batches):
        for pdf in batches:
            texts = [extract(h) for h in pdf.html]
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(lean(run), "page_id long, url string, text string, n_chars long")
