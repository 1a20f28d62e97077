"""Revisions without effect taken out of parts in place: equal pairs, noise, and what was inserted and then deleted.

The rules are those of ``revisions.strip_noops``, here on the elements of a part: a deletion goes, an insertion loses its tags and keeps what it
holds, and all other bytes stay. Bookmarks, comment ranges and proof marks don't part a pair."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers.expat import ExpatError

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.functions.rules import TRANSPARENT_MARKS
from paragrid.operators.revisions import NEAR
from paragrid.sources.markup import EDIT, Node, paragraphs_of, splice

_BRACKETS, _VALUE = set("[](){}〈〉《》"), set("%&$€£¥")
KINDS = ("pair", "noise", "phantom")


def _text(node: Node) -> str:
    return "".join(n.text for n in node.walk() if n.tag in ("t", "delText"))


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _pairs(children: list[Node], out: list[tuple]) -> list[Node]:
    """The children after folding: a stack whose top is the last child that is no mark."""
    stack: list[Node] = []
    for c in children:
        k = len(stack) - 1
        while k >= 0 and stack[k].tag in TRANSPARENT_MARKS:
            k -= 1
        top = stack[k] if k >= 0 else None
        if top is None or {top.tag, c.tag} != {"ins", "del"} or _plain(_text(top)) != _plain(_text(c)):
            stack.append(c)
            continue
        gone, kept = (top, c) if c.tag == "ins" else (c, top)
        out += [("pair", gone.start, gone.end), ("tag", kept.start, kept.inner), ("tag", kept.close, kept.end)]
        if c is kept:
            stack[k : k + 1] = []
            stack += kept.children
        else:
            stack[k : k + 1] = kept.children
    return stack


def paragraph_noops(p: Node, keep_phantoms: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what goes: pair, noise, phantom, and the tags of kept insertions."""
    out: list[tuple[str, int, int]] = []
    children, kept = _pairs(p.children, out), []
    for k, c in enumerate(children):
        text = _text(c) if c.tag in ("ins", "del") else None
        if text is not None and not any(x.isalnum() or x in _VALUE for x in text):
            content = lambda n: n.tag in ("ins", "del") and any(x.isalnum() for x in _text(n))
            bracket = _plain(text) and all(x in _BRACKETS for x in _plain(text))
            if not (bracket and any(map(content, [*kept[-NEAR:], *children[k + 1 : k + 1 + NEAR]]))):
                out.append(("noise", c.start, c.end))
                continue
        kept.append(c)
    children = _pairs(kept, out)
    if not keep_phantoms:
        for n in [m for c in children for m in [c, *c.walk()]]:
            below = list(n.walk()) if n.tag == "ins" else []
            if any(m.tag == "del" for m in below) and not any(m.tag == "t" and m.text.strip() for m in below):
                out.append(("phantom", n.start, n.end))
    return out


def noop_edits(parts: DataFrame, keep_phantoms: bool = False) -> DataFrame:
    """Edits, each with its kind; ill-formed parts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, part, content in zip(batch["path"], batch["part"], batch["content"]):
                try:
                    found = paragraphs_of(content)
                except ExpatError:
                    found = []
                rows += [(path, part, s, e, b"", kind) for p in found for kind, s, e in paragraph_noops(p, keep_phantoms)]
            yield pd.DataFrame(rows, columns=["path", "part", "start", "end", "content", "kind"])

    return parts.where("content is not null").select("path", "part", "content").mapInPandas(run, EDIT + ", kind string")


def strip_parts(parts: DataFrame, keep_phantoms: bool = False) -> DataFrame:
    """path, part, content, error, and how many pairs, noise and phantoms went, of the parts that change."""
    edits = noop_edits(parts, keep_phantoms)
    counts = edits.groupBy("path", "part").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
    return splice(parts, edits.drop("kind")).join(counts, ["path", "part"])
