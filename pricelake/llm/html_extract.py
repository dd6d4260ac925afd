"""HTML main text by a tree-structured graphical model.

A page is parsed into a tree of elements and text pieces. Every node has a hidden label, content or
not. Node potentials are log-linear in features of the node (tag, words of class and id, length,
links, share of the page's unlinked words); potentials of parent and child couple their labels. Sum-product messages go up from the
leaves and down from the root and give each node's marginal exactly; text pieces whose marginal is
above one half are the article. The weights are fitted by gradient ascent on the likelihood of the
labelled pages of ``html_pages`` (observed minus expected counts, the latter from the same messages).

Character references are decoded; white space inside a block becomes one space; blocks are joined by
one space in page order. Scripts, styles, comments in markup, and the head are never text. The parser
keeps no recursion, so depth is no limit; pages are independent of each other, and a task holds one
Arrow batch.

Defined results: null and empty html give an empty text; broken markup is read leniently (unclosed
elements end with their parent, stray end tags are ignored, a ``<`` that starts no tag is text);
repeated rows are extracted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.llm.common import col
from pricelake.llm.html_pages import labelled

PAGES = 500
EPOCHS = 18
#: Kinds of edges, see ``Tree.edge``.
EDGES = 6

# How HTML treats its elements.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "template", "textarea", "title", "noscript", "iframe", "svg", "object", "select", "option", "xmp"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong "
              "sub sup time tt u var button nobr ruby rb rt wbr img".split())
_FLOW = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption tr td th address".split())
_MAIN = {"article", "main"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"table", "ul", "ol", "dl", "td", "th", "article", "main", "section", "body", "html"}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LENIENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Tree:
    """Nodes in page order: parent, tag (None: text), names of class and id, text, block number."""

    def __init__(self, page: str):
        self.parent, self.tag, self.names, self.text, self.block = [-1], ["#root"], [()], [""], [0]
        self.glue: dict[int, str] = {}                 # white space in front of a text piece
        self.open: dict[str, int] = {}                 # elements of each tag on the stack
        stack, block, i, n, blank = [0], 0, 0, len(page), False
        tags, unclosed = _TAG, set()                   # a tag whose quotes do not end is sought once, so the scan is linear
        while i < n:
            j = page.find("<", i)
            m = None
            while j >= 0:                              # the next < that starts markup
                if page.startswith("<!--", j) or page[j + 1:j + 2] in ("!", "?"):
                    break
                m = tags and tags.match(page, j)
                if not m and tags and page[j + 1:j + 3].lstrip("/")[:1].isalpha():
                    tags = _LENIENT if tags is _TAG else None
                    m = tags and tags.match(page, j)
                if m:
                    break
                j = page.find("<", j + 1)
            piece = page[i:j] if j >= 0 else page[i:]
            if piece:
                if piece.isspace():
                    blank = True
                else:
                    self._add(stack[-1], None, (), html.unescape(piece), block)
                    if blank:
                        self.glue[len(self.tag) - 1] = " "
                    blank = False
            if j < 0:
                break
            if m is None:                              # a comment or declaration
                end = page.find("-->", j + 4) if page.startswith("<!--", j) else page.find(">", j)
                i = n if end < 0 else end + (3 if page.startswith("<!--", j) else 1)
                continue
            i, tag = m.end(), m.group(2).lower()
            if m.group(1):
                if self.open.get(tag):
                    while self._pop(stack) != tag:
                        pass
                if tag not in _INLINE:
                    block, blank = block + 1, False
                continue
            if tag in _RAW:
                end = None if tag in unclosed else re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(page, i)
                if end is None:
                    unclosed.add(tag)
                if not m.group(3).endswith("/"):
                    i = end.end() if end else (n if tag in ("script", "style") else i)
                continue
            if tag not in _INLINE:
                block, blank = block + 1, False
                self._close(stack, tag)
            if tag in _VOID or m.group(3).endswith("/"):
                continue
            names = tuple(x for g in _NAMES.findall(m.group(3)) for x in _SPLIT.split("".join(g).lower()) if x)
            self._add(stack[-1], tag, names, "", block)
            stack.append(len(self.tag) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1

    def _pop(self, stack: list[int]) -> str:
        tag = self.tag[stack.pop()]
        self.open[tag] -= 1
        return tag

    def _add(self, parent, tag, names, text, block) -> None:
        for a, x in ((self.parent, parent), (self.tag, tag), (self.names, names), (self.text, text), (self.block, block)):
            a.append(x)

    def _close(self, stack: list[int], tag: str) -> None:
        """Ends what a new block ends: an open paragraph, or the list item or cell before it."""
        ends = _CLOSES.get(tag, set()) | {"p"}
        if not any(self.open.get(t) for t in ends):
            return
        for k in range(len(stack) - 1, 0, -1):
            t = self.tag[stack[k]]
            if t in ends:
                while len(stack) > k:
                    self._pop(stack)
                return
            if t in _SCOPE and t != tag:
                return

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        words, links, in_link = [0] * n, [0] * n, [False] * n
        for v in range(1, n):
            p = self.parent[v]
            in_link[v] = in_link[p] or self.tag[p] == "a"
            if self.tag[v] is None:
                words[v] = len(self.text[v].split())
                links[v] = words[v] if in_link[v] else 0
        for v in range(n - 1, 0, -1):
            words[self.parent[v]] += words[v]
            links[self.parent[v]] += links[v]
        out, plain = [], max(1, words[0] - links[0])
        for v in range(n):
            size = f"{min(6, words[v].bit_length())}"
            if self.tag[v] is None:
                t = self.text[v].strip()
                out.append(["text", f"n{size}", f"stop{t[-1:] in '.!?'}", f"link{in_link[v]}",
                            *(["copy"] if "©" in t or "copyright" in t.lower() else [])])
            else:
                share = links[v] / words[v] if words[v] else 0
                out.append([f"t:{self.tag[v]}", f"e{min(11, words[v].bit_length())}", f"l{0 if not share else 1 + int(2.99 * share)}",
                            f"s{int(7.99 * (words[v] - links[v]) / plain)}", *(f"c:{x}" for x in self.names[v])])
        return out

    def edge(self, v: int) -> int:
        """Kind of the edge above a node: to text, to an inline element, to a paragraph or the like, to
        any other block; the last two apart below an element that is named for the main text."""
        t = self.tag[v]
        return 0 if t is None else 1 if t in _INLINE else (2 if t in _FLOW else 3) + 2 * (self.tag[self.parent[v]] in _MAIN)

    def article(self, content: list[float]) -> str:
        blocks: list[list[str]] = []
        last = None
        for v, t in enumerate(self.tag):
            if t is None and content[v] > 0.5:
                if self.block[v] != last:
                    blocks.append([])
                    last = self.block[v]
                blocks[-1].append(self.glue.get(v, "") + self.text[v])
        return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


class Model:
    """Weights of the features (for the label content) and tables of the edges (parent, child)."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.pair = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(EDGES)]

    def messages(self, tree: Tree, features: list[list[str]]):
        """Marginal of content of every node, and of each edge's labels when asked for in training."""
        n, get = len(features), self.weight.get
        own = [sum(get(f, 0.0) for f in fs) for fs in features]
        kind = [tree.edge(v) for v in range(n)]
        b0, b1 = [0.0] * n, own[:]                     # beliefs of a node from its subtree
        up0, up1 = [0.0] * n, [0.0] * n                # message to the parent
        for v in range(n - 1, 0, -1):                  # upward: children come after their parents
            e, p = self.pair[kind[v]], tree.parent[v]
            up0[v] = _lse(e[0][0] + b0[v], e[0][1] + b1[v])
            up1[v] = _lse(e[1][0] + b0[v], e[1][1] + b1[v])
            b0[p] += up0[v]
            b1[p] += up1[v]
        marginal, edges = [0.0] * n, [None] * n
        full0, full1 = b0, b1
        for v in range(n):                             # downward: beliefs with the rest of the tree
            if v:
                e, p = self.pair[kind[v]], tree.parent[v]
                rest0, rest1 = full0[p] - up0[v], full1[p] - up1[v]
                edges[v] = (rest0, rest1, b0[v], b1[v])
                full0[v] = b0[v] + _lse(e[0][0] + rest0, e[1][0] + rest1)
                full1[v] = b1[v] + _lse(e[0][1] + rest0, e[1][1] + rest1)
            d = full0[v] - full1[v]
            marginal[v] = 1 / (1 + math.exp(d)) if d < 700 else 0.0
        return marginal, edges, kind

    def fit(self, pages: list[tuple[str, set[str]]]) -> Model:
        data = []
        for page, own in pages:
            tree = Tree(page)
            n = len(tree.tag)
            inside, total = [0] * n, [0] * n
            for v in range(n - 1, -1, -1):
                if tree.tag[v] is None:
                    total[v] = len(tree.text[v])
                    inside[v] = total[v] if tree.text[v].strip() in own else 0
                if v:
                    inside[tree.parent[v]] += inside[v]
                    total[tree.parent[v]] += total[v]
            # an element is content if most of its text is
            data.append((tree, tree.features(), [int(inside[v] > 0.5 * total[v]) for v in range(n)]))
        scale: dict[str, float] = {}
        for epoch in range(EPOCHS):
            rate = 0.5 / (1 + epoch / 8)
            for tree, features, label in data:
                marginal, edges, kind = self.messages(tree, features)
                grad: dict[str, float] = {}
                for v, fs in enumerate(features):
                    d = label[v] - marginal[v]
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + d
                for f, d in grad.items():              # per-weight step sizes
                    scale[f] = scale.get(f, 1.0) + d * d
                    self.weight[f] = self.weight.get(f, 0.0) * (1 - 1e-4) + rate * d / math.sqrt(scale[f])
                table = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(EDGES)]
                for v in range(1, len(features)):
                    rest0, rest1, own0, own1 = edges[v]
                    e, g = self.pair[kind[v]], table[kind[v]]
                    s = [[e[0][0] + rest0 + own0, e[0][1] + rest0 + own1], [e[1][0] + rest1 + own0, e[1][1] + rest1 + own1]]
                    z = _lse(_lse(*s[0]), _lse(*s[1]))
                    g[label[tree.parent[v]]][label[v]] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            g[a][b] -= math.exp(s[a][b] - z)
                for k in range(EDGES):
                    for a in (0, 1):
                        for b in (0, 1):
                            f = f"#{k}{a}{b}"
                            scale[f] = scale.get(f, 1.0) + table[k][a][b] ** 2
                            self.pair[k][a][b] += rate * table[k][a][b] / math.sqrt(scale[f])
        return self

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        tree = Tree(page)
        return tree.article(self.messages(tree, tree.features())[0])


_FITTED: list[Model] = []


def model() -> Model:
    """The model of the labelled pages, fitted once per driver."""
    if not _FITTED:
        _FITTED.append(Model().fit(labelled(PAGES)))
    return _FITTED[0]


def main_text(spark, page: Column) -> Column:
    shared = spark.sparkContext.broadcast(model())

    def extract(pages: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.extract(p.as_py()) for p in pages], pa.string())

    return F.arrow_udf(extract, "string")(page.cast("string"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    out = pages.select(col(page_id).alias("page_id"), col(url).alias("url"), main_text(pages.sparkSession, col(page)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
