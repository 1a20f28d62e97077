"""Main text of web pages by a tree-structured graphical model over their elements.

Each element (runs of bare text in a container count as one) is in one of three states: it wraps both kinds, it is content,
or it is boilerplate. An element's features (tag, words of class, id and role, link density, length of text) give its own
potential; a table of parent and child states gives the potential of each edge. Sum-product messages go up from the leaves and
down from the root, and yield each element's marginals exactly, as the graph is a tree. Text whose element is content with a
marginal of a half or more is kept.

The model is trained by counting over labelled pages: elements carry their state in a ``data-state`` attribute, which
is no feature. ``labelled_pages`` makes such pages, of many layouts, from a seed.

Output: character references decoded; white space within a block becomes one blank; blocks, in page order, joined by a
line feed. Line breaks within a block are white space.

Defined cases: null or empty html gives an empty text; so do pages without content. A page of bare text without
elements is all content. A head without an end tag ends at the first text or element that no head may hold. Formulas, and what stands
in for scripts, objects and players, are text like any other. Tags left open at the end are closed there, a tag cut off at the end is dropped. Repeated rows and null ids pass as
they are. Columns other than the three named are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.llm.common import map_batches

WRAPS, CONTENT, BOILERPLATE = range(3)
STATES = "wcb"

# Kinds of elements in HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"head", "script", "style", "template", "svg", "iframe", "select", "textarea", "title", "canvas", "annotation", "annotation-xml"}
RAW = {"script", "style", "textarea", "title", "iframe", "xmp"}
#: What a head may hold: any other element ends it, as its end tag may be left out.
IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
#: Sources of a player or object, which stand within a line.
SOURCES = {"source", "track", "param"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"} | {"audio", "object", "video"} | {"math", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
CONTAINERS = {"#root", "html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "figure", "center", "details", "fieldset"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"table", "ul", "ol", "dl", "#root", "div", "section", "article"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|data-state)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CUT = re.compile(r"<[a-zA-Z/][^>]*\Z")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    words: list[str] = field(default_factory=list)
    state: int | None = None
    chars: int = 0
    linked: int = 0


@dataclass
class Page:
    """Elements with parents before children, and the text as (element, text, ends a block before it)."""

    nodes: list[Node]
    texts: list[tuple[int, str, bool]]


def _attributes(source: str) -> tuple[list[str], int | None]:
    words, state = [], None
    for name, value in _ATTRIBUTE.findall(source):
        value = value.strip("\"'")
        if name.lower() == "data-state":
            state = STATES.index(value)
        else:
            words += _WORD.findall(html.unescape(value).lower())
    return words, state


def parse(source: str) -> Page:
    """The tree of a page as browsers see it, as far as the model needs."""
    page = Page([Node("#root", -1)], [])
    stack: list[tuple[str, int]] = [("#root", 0)]  # open tags with the element that their text belongs to
    at, hidden, links, fresh, bare = 0, 0, 0, True, -1
    end = len(source)

    def text(piece: str) -> None:
        nonlocal fresh, bare
        piece = html.unescape(piece)
        n = len("".join(piece.split()))
        owner = stack[-1][1]
        if n and page.nodes[owner].tag in CONTAINERS:
            if bare < 0:
                page.nodes.append(Node("#text", owner))
                bare = len(page.nodes) - 1
            owner = bare
        page.texts.append((owner, piece, fresh))
        fresh = False
        page.nodes[owner].chars += n
        if links:
            page.nodes[owner].linked += n

    def pop() -> None:
        nonlocal hidden, links, fresh, bare
        tag, _ = stack.pop()
        hidden -= tag in HIDDEN
        links -= tag == "a"
        if tag not in INLINE:
            fresh, bare = True, -1

    while at < end:
        m = _TAG.search(source, at)
        piece = source[at : m.start() if m else end]
        if not m and (cut := _CUT.search(piece)):
            piece = piece[: cut.start()]
        if hidden and stack[-1][0] == "head" and piece.strip():
            pop()
        if piece and not hidden:
            text(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not any(t == "p" for t, _ in stack) and not hidden:
                fresh, bare = True, -1
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if hidden and tag not in IN_HEAD and not any(t == "template" for t, _ in stack):
            k = next((k for k, (t, _) in enumerate(stack) if t == "head"), len(stack))
            while len(stack) > k:
                pop()
        if tag in SOURCES:
            continue
        if tag == "br":
            if not hidden:
                page.texts.append((stack[-1][1] if bare < 0 else bare, " ", fresh))
                fresh = False
            continue
        block = tag not in INLINE
        if block:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph; items end their like
                if stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()):
                    while len(stack) > k:
                        pop()
                elif stack[k][0] in SCOPES:
                    break
            fresh, bare = True, -1
        if tag in VOID:
            continue
        if m[3].endswith("/") and tag in HIDDEN:
            continue
        words, state = _attributes(m[3]) if m[3] else ([], None)
        owner = stack[-1][1]
        if block or (words and tag != "a"):
            page.nodes.append(Node(tag, owner if bare < 0 else bare, words, state))
            owner = len(page.nodes) - 1
        elif bare >= 0:
            owner = bare
        stack.append((tag, owner))
        hidden += tag in HIDDEN
        links += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            at = close.start() if close else end
    for k in range(len(page.nodes) - 1, 0, -1):  # texts of a subtree
        node, up = page.nodes[k], page.nodes[page.nodes[k].parent]
        up.chars += node.chars
        up.linked += node.linked
    return page


def features(node: Node) -> list[str]:
    links = node.linked / node.chars if node.chars else 0.0
    found = [f"tag {node.tag}", f"links {0 if links < 0.05 else 1 if links < 0.35 else 2 if links < 0.75 else 3}", f"chars {min(5, int(math.log2(1 + node.chars) / 2))}"]
    return found + [f"word {w}" for w in set(node.words)]


class Model:
    """Potentials by counting; ``temper`` weakens features, as they aren't independent."""

    def __init__(self, pages: list[Page], temper: float = 0.7, smooth: float = 0.5):
        self.temper = temper
        edges, seen, states = [[smooth] * 3 for _ in range(3)], Counter(), [0, 0, 0]
        for page in pages:
            state = self._filled(page)
            for k, node in enumerate(page.nodes):
                states[state[k]] += 1
                if k:
                    edges[state[node.parent]][state[k]] += 1
                for f in features(node):
                    seen[f, state[k]] += 1
        self.edge = [[x / sum(row) for x in row] for row in edges]
        every = {f for f, _ in seen}
        self.feature = {f: [math.log((seen[f, y] + smooth) / (states[y] + 20 * smooth)) for y in range(3)] for f in every}
        least = {f: [v - sum(row) / 3 for v in row] for f, row in self.feature.items()}  # only differences between states matter
        self.feature = least

    @staticmethod
    def _filled(page: Page) -> list[int]:
        """States of labelled pages: an element without a label has its parent's, the root wraps."""
        out: list[int] = []
        for node in page.nodes:
            out.append(node.state if node.state is not None else out[node.parent] if node.parent >= 0 else WRAPS)
        return out

    def marginals(self, page: Page) -> list[list[float]]:
        nodes, edge = page.nodes, self.edge
        own: list[list[float]] = []
        for k, node in enumerate(nodes):
            score = [0.0, 0.0, 0.0] if k else [0.0, -9.0, -9.0]
            for f in features(node):
                row = self.feature.get(f)
                if row:
                    for y in range(3):
                        score[y] += self.temper * row[y]
            top = max(score)
            own.append([math.exp(s - top) for s in score])
        up: list[list[float]] = [[1.0] * 3 for _ in nodes]
        belief = [list(x) for x in own]
        for k in range(len(nodes) - 1, 0, -1):  # upward: what each subtree says of its parent
            b = belief[k]
            message = [row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in edge]
            total = sum(message)
            up[k] = message = [x / total for x in message]
            p = belief[nodes[k].parent]
            for y in range(3):
                p[y] *= message[y]
            total = sum(p)
            for y in range(3):
                p[y] /= total
        for k in range(len(nodes)):  # downward: what the rest of the tree says of each element
            b = belief[k]
            if k:
                p, m = belief[nodes[k].parent], up[k]
                rest = [p[y] / m[y] for y in range(3)]
                b = [b[y] * (rest[0] * edge[0][y] + rest[1] * edge[1][y] + rest[2] * edge[2][y]) for y in range(3)]
            total = sum(b)
            belief[k] = [x / total for x in b]
        return belief

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        kept = [b[CONTENT] >= 0.5 for b in self.marginals(page)]
        if all(node.tag in ("#root", "#text", "html", "body", "head", "title") for node in page.nodes):
            kept = [True] * len(kept)
        blocks: list[list[str]] = []
        broken = True
        for owner, piece, fresh in page.texts:
            broken |= fresh
            if kept[owner]:
                if broken:
                    blocks.append([])
                    broken = False
                blocks[-1].append(piece)
        return "\n".join(x for b in blocks if (x := " ".join("".join(b).split())))


# The labelled pages: layouts drawn from a seed.

_CLASSES = {
    "article": ["article", "post", "entry", "story", "content", "main content", "post body", "entry content", "article body", "text", "page content", "blog post", "news", "single post", "main", "main", "body", "content area", "primary"],
    "nav": ["nav", "menu", "navbar", "navigation", "menu bar", "breadcrumb", "topnav", "links", "pagination", "toc menu", "skip links"],
    "header": ["header", "site header", "masthead", "top", "banner", "logo bar", "page header", "branding"],
    "footer": ["footer", "site footer", "bottom", "copyright", "colophon", "legal footer", "foot"],
    "side": ["sidebar", "side", "widget", "related", "recommended", "popular posts", "aside", "trending", "more stories", "tags widget", "rail", "teaser"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner ad", "adsbox", "promoted", "commercial"],
    "notice": ["cookie notice", "notice", "consent", "cookie banner", "gdpr", "alert", "popup", "modal", "paywall notice", "newsletter", "subscribe", "share", "social share", "toolbar"],
    "comments": ["comments", "comment list", "responses", "discussion", "respond", "reader comments", "replies", "disqus thread", "feedback"],
    "form": ["form", "search form", "login form", "contact form", "newsletter form", "signup", "search"],
    "wrap": ["wrapper", "container", "page", "site", "layout", "row", "col", "inner", "grid", "outer", "app", ""],
}


def _page(r: random.Random) -> str:
    def words(low: int, high: int) -> str:
        out = " ".join("".join(r.choice(("ka", "lo", "mi", "tre", "su", "ven", "da", "or", "ni", "sha", "el", "pu")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return out.capitalize() + r.choice((".", ".", "", "?", "…"))

    def element(tag: str, inside: str, state: str = "", kind: str = "", named: float = 0.8) -> str:
        label = f' data-state="{state}"' if state else ""
        name = ""
        if kind and r.random() < named:
            name = f' {r.choice(("class", "class", "id"))}="{r.choice(_CLASSES[kind]).replace(" ", r.choice((" ", "-")))}"'
        return f"<{tag}{name}{label}>{inside}</{tag}>"

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def box(tag: str, inside: str, kind: str) -> str:
        plain = tag in ("div", "section", "ul", "p", "span")
        return element(tag, inside, "b", kind, 0.97 if plain else 0.5)

    def some(odds: float, make) -> str:
        return make() if r.random() < odds else ""

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.62:
            a = f' <a href="/x">{words(1, 3)}</a> {words(2, 9)}' if r.random() < 0.2 else ""
            long = r.random()
            return f"<p>{words(1, 90) if long < 0.67 else words(300, 900) if long < 0.7 else words(1, 6)}{a}</p>"
        if kind < 0.72:
            return f"<h{r.randint(2, 4)}>{words(1, 8)}</h{r.randint(2, 4)}>"
        if kind < 0.80:
            return "<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.85:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.89:
            return "<table><tr>" + "".join(f"<td>{words(1, 5)}</td>" for _ in range(4)) + "</tr></table>"
        if kind < 0.92:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.95:
            return f"<figure><img src='x'><figcaption>{words(2, 12)}</figcaption></figure>"
        return f"<div>{words(4, 60)}</div>"

    def advert() -> str:
        return box(r.choice(("div", "div", "aside", "section", "p", "ins")), r.choice((words(1, 14), f"<a href='/ad'>{words(1, 8)}</a>", f"<p>{words(3, 20)}</p>")), "ad")

    loose = r.random() < 0.15  # the article's blocks stand in the page without an element around them
    own = (lambda x: re.sub(r"^<(\w+)", r'<\1 data-state="c"', x)) if loose else (lambda x: x)
    body = some(0.93, lambda: own(f"<h1>{words(1, 12)}</h1>"))
    if r.random() < 0.25 and not loose:
        body = f"<header>{body}{some(0.5, lambda: f'<p>{words(2, 12)}</p>')}</header>"
    for _ in range(r.randint(1, 14)):
        body += own(paragraph())
        body += some(0.05, advert)
    body += some(0.1, lambda: box("div", links(3), "side"))
    body += some(0.08, lambda: box(r.choice(("div", "form")), words(1, 8), "notice"))
    tag = r.choice(("article", "article", "main", "div", "section"))
    main = body if loose else element(tag, body, "c", "article", 0.98 if tag in ("div", "section") else 0.4)
    if not loose and tag == "article" and r.random() < 0.3:
        main = element("main", main, "w", "wrap", 0.3)
    comments = some(0.35, lambda: box(r.choice(("section", "div", "div")), f"<h3>{words(1, 3)}</h3>" + "".join(element(r.choice(("div", "li", "article")), f"<p>{words(2, 60)}</p>", "b", "comments", 0.5) for _ in range(r.randint(1, 5))), "comments"))
    side = some(0.45, lambda: box(r.choice(("aside", "div", "section")), r.choice((f"<h3>{words(1, 3)}</h3><ul>{links(4)}</ul>", f"<p>{words(4, 30)}</p>", f"<ul>{links(5)}</ul>")), "side"))
    middle = [main, side] if r.random() < 0.7 else [side, main]
    inner = "".join(middle) + comments
    if r.random() < 0.5:
        inner = element("div", inner, "w", "wrap", 0.8)
    top = some(0.45, lambda: box(r.choice(("header", "div")), r.choice((words(1, 6), f"<h1><a href='/'>{words(1, 3)}</a></h1>", f"<p>{words(2, 9)}</p>", f"<nav><ul>{links(4)}</ul></nav>")), "header"))
    top += some(0.8, lambda: box(r.choice(("nav", "nav", "div", "ul")), f"<ul>{links(r.randint(2, 8))}</ul>", "nav"))
    top += some(0.5, advert) + some(0.3, lambda: box("div", f"<p>{words(3, 30)}</p><button>{words(1, 2)}</button>", "notice"))
    low = some(0.3, lambda: box(r.choice(("form", "div")), f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>", "form"))
    low += some(0.25, advert) + some(0.85, lambda: box(r.choice(("footer", "footer", "div")), r.choice((f"&copy; {words(2, 20)}", f"<p>{words(3, 25)}</p>", f"<ul>{links(4)}</ul><p>{words(3, 9)}</p>")), "footer"))
    page = top + inner + low
    if r.random() < 0.4:
        page = element("div", page, "w", "wrap", 0.8)
    return page if r.random() < 0.05 else f"<html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>"


def labelled_pages(n: int = 1500, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [_page(r) for _ in range(n)]


def train(pages: list[str] | None = None) -> Model:
    """A model from labelled pages (``labelled_pages`` by default)."""
    return Model([parse(p) for p in (labelled_pages() if pages is None else pages)])


def extract(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = df.sparkSession.sparkContext.broadcast(model or train())  # a few hundred features

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [shared.value.extract(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html_col), run, f"page_id {kind}, url string, text string, n_chars long")
