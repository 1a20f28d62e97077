"""Byte places in the markup of parts, and edits by place: what no edit touches stays as it is, byte for byte."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.sources.tables import map_rows

NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
EDIT = "path string, part string, start long, end long, content binary"
_OPEN = re.compile(rb"<[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*>")
INSERTED, DELETED = ("ins", "moveTo"), ("del", "moveFrom")


class Node:
    """An element: its name (without prefix, None outside the namespace), the places of its tags, and what it holds."""

    __slots__ = ("attrs", "children", "close", "end", "inner", "start", "tag", "text")

    def __init__(self, tag, attrs, start, inner):
        self.tag = tag
        self.attrs = attrs
        self.start = start
        self.inner = self.close = self.end = inner
        self.children = []
        self.text = ""

    def get(self, name: str) -> str | None:
        return self.attrs.get(f"{NAMESPACE}}}{name}")

    def child(self, tag: str) -> Node | None:
        return next((c for c in self.children if c.tag == tag), None)

    def walk(self) -> Iterator[Node]:
        left = self.children[::-1]
        while left:
            node = left.pop()
            yield node
            if node.children:
                left += node.children[::-1]


def tree(xml: bytes) -> Node:
    """The root element of a UTF-8 part; ExpatError where it is ill-formed or in another encoding."""
    top = Node(None, {}, 0, 0)
    stack = [top]
    parser = expat.ParserCreate(namespace_separator="}")
    tags: dict[str, str | None] = {}
    push, pop, opened = stack.append, stack.pop, _OPEN.match

    def start(name, attrs):
        if name not in tags:
            uri, _, local = name.rpartition("}")
            tags[name] = local if uri == NAMESPACE else None
        place = parser.CurrentByteIndex
        node = Node(tags[name], attrs, place, opened(xml, place).end())
        stack[-1].children.append(node)
        push(node)

    def end(_):
        node = pop()
        if xml[node.inner - 2 : node.inner] != b"/>":
            node.close = parser.CurrentByteIndex
            node.end = xml.index(b">", node.close) + 1

    def characters(data):
        stack[-1].text += data

    _parse(parser, xml, start, end, characters)
    return top.children[0]


def _parse(parser, xml: bytes, start, end, characters) -> None:
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.XmlDeclHandler = start, end, characters, _declaration
    try:
        parser.Parse(xml, True)
    finally:  # or else parser and handlers hold each other, and what was read, until the next collection
        parser.StartElementHandler = parser.EndElementHandler = parser.CharacterDataHandler = None


def _declaration(_, encoding, __):
    if encoding and encoding.lower() not in ("utf-8", "us-ascii"):
        raise expat.ExpatError(f"encoding {encoding}")


#: Where a place in a part stands: in no run of a paragraph, among what holds a paragraph's runs, in a run, in a run's text.
_OUT, _AMONG, _RUN, _TEXT = range(4)


def kept_texts(xml: bytes) -> list[str]:
    """The text of each paragraph of a part when revisions are accepted, as ``own`` and ``piece`` give it, without a tree; ExpatError as in ``tree``."""
    made: list[list[str]] = []
    stack: list[tuple[int, bool, list[str]]] = [(_OUT, False, [])]
    tags: dict[str, str | None] = {}
    parser = expat.ParserCreate(namespace_separator="}")

    def start(name, attrs):
        if name not in tags:
            uri, _, local = name.rpartition("}")
            tags[name] = local if uri == NAMESPACE else None
        tag, (at, gone, text) = tags[name], stack[-1]
        if tag == "p":
            made.append([])
            stack.append((_AMONG, False, made[-1]))
        elif at == _AMONG:
            stack.append((_OUT if tag == "pPr" else _RUN if tag == "r" else _AMONG, gone or tag in DELETED, text))
        elif at == _RUN and not gone:
            if tag == "tab":
                text.append("\t")
            elif tag == "cr" or (tag == "br" and attrs.get(f"{NAMESPACE}}}type") != "page"):
                text.append("\n")
            stack.append((_TEXT if tag in ("t", "delText") else _OUT, gone, text))
        else:
            stack.append((_OUT, gone, text))

    def end(_):
        stack.pop()

    def characters(data):
        at, _, text = stack[-1]
        if at == _TEXT:
            text.append(data)

    _parse(parser, xml, start, end, characters)
    return ["".join(t) for t in made]


def paragraphs_of(xml: bytes) -> list[Node]:
    """All paragraphs of a part in order, those within others too."""
    root = tree(xml)
    return [n for n in [root, *root.walk()] if n.tag == "p"]


def own(p: Node, kind: str = "regular") -> Iterator[tuple[Node, str, Node]]:
    """(run, kind of its revision, child of p that holds it) of a paragraph in order, not those of paragraphs within it."""
    found: list[tuple[Node, str, Node]] = []

    def below(node: Node, kind: str, top: Node | None) -> None:
        for c in node.children:
            tag = c.tag
            if tag == "r":
                found.append((c, kind, top or c))
            elif tag in INSERTED:
                below(c, "ins" if kind in ("regular", "ins") else "ins_then_del", top or c)
            elif tag in DELETED:
                below(c, "del" if kind in ("regular", "del") else "ins_then_del", top or c)
            elif c.children and tag not in ("p", "pPr"):
                below(c, kind, top or c)

    below(p, kind, None)
    return iter(found)


def piece(run: Node) -> str:
    """A run's text, with tabs and line breaks."""
    text = ""
    for c in run.children:
        if c.tag in ("t", "delText"):
            text += c.text
        elif c.tag == "tab":
            text += "\t"
        elif c.tag == "cr" or (c.tag == "br" and c.get("type") != "page"):
            text += "\n"
    return text


def spliced(content: bytes, edits: list[tuple[int, int, bytes]]) -> tuple[bytes, str | None]:
    """A part with edits in place (see ``splice``), and the error that leaves it as it was."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1] if e[1] > e[0] else -(2**62), e[1], e[2])):
        if at and end <= at and start < at:
            continue
        if start < at or end > len(content):
            return content, f"edit at {start} overlaps another or passes the end"
        out += [content[at:start], new]
        at = end
    return b"".join([*out, content[at:]]), None


def splice(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """path, part, content, error: the parts that have edits, with these in place, in one pass over each part.

    Edits within one that replaces more are dropped; insertions at one place stay in the order of ``start, end, content``. An edit that
    overlaps its forerunner in part, or lies outside the part, makes an error, and the part stays as it was."""
    gathered = edits.groupBy("path", "part").agg(F.sort_array(F.collect_list(F.struct("start", "end", "content"))).alias("edits"))
    joined = parts.where("content is not null").select("path", "part", "content").join(gathered, ["path", "part"])

    def of_part(path: str, part: str, content: bytes, changes: list[dict]) -> list[tuple]:
        return [(path, part, *spliced(content, [(e["start"], e["end"], e["content"]) for e in changes]))]

    return map_rows(joined, of_part, "path string, part string, content binary, error string", 200)
