"""Words left in the source language, with their contexts: one scan of each text by an automaton of all markers.

A marker is a pattern that begins with letters; these beginnings go into one Aho-Corasick automaton per language, and only where one of them
ends a hit is the pattern itself tried. ``scan`` looks at both views of a paragraph: what is kept (three words at least) and what is deleted
(any word), and adds a finding where a view is dense with hits. ``scan_parts`` looks at each text element and each numbering level of
auxiliary parts. A hit whose surroundings hold an allowed phrase doesn't count.

Defined cases: null and blank texts have no findings, rows of a null or unknown language neither (``scanned`` tells these apart from clean
ones); a marker's hits don't overlap each other, those of different markers may.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from xml.parsers.expat import ExpatError

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.functions.rules import ALLOWED_CONTEXTS, REMNANT_MARKERS, SUBSTRING_LANGUAGES
from paragrid.sources.markup import tree

AUXILIARY = r"word/(?:numbering|comments|footnotes|endnotes|header[^/]*|footer[^/]*)\.xml"
#: Surroundings in which Italian hits don't count as findings (they do count for density).
ITALIAN_SURROUNDINGS = re.compile(r"\b[cC]ome\b|non-\w|per cent|per annum|per se")
RADIUS, SHOWN = 30, 100
Markers = tuple[tuple[str, tuple[str, ...]], ...]


def folded(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def heads(pattern: str) -> list[str]:
    """The letters that any match of a pattern begins with; one for each branch of a leading group."""
    pattern = re.sub(r"^(?:\(\?i\))?(?:\\b)?", "", pattern)
    group = re.match(r"\((?:\?:)?([^()]*)\)(.*)", pattern, re.DOTALL)
    if group:
        return [h for branch in group[1].split("|") for h in heads(branch + group[2])]
    plain = re.match(r"[^\\\[\](){}.*+?|^$]*", pattern)[0]
    if pattern[len(plain) : len(plain) + 1] in ("*", "?", "{"):
        plain = plain[:-1]
    if not plain:
        raise ValueError(f"a marker begins with letters: {pattern}")
    return [folded(plain)]


@lru_cache(maxsize=64)
def automaton(patterns: tuple[str, ...], anywhere: bool):
    """The automaton of the markers' beginnings, and each marker's own pattern."""
    made, tried = ahocorasick.Automaton(), []
    found: dict[str, list[int]] = {}
    for k, p in enumerate(patterns):
        tried.append(re.compile(p) if anywhere else re.compile(rf"\b{p}\b", re.IGNORECASE))
        for h in heads(p):
            found.setdefault(h, []).append(k)
    for h, ks in found.items():
        made.add_word(h, (len(h), tuple(ks)))
    made.make_automaton()
    return made, tried


def hits(text: str, patterns: tuple[str, ...], anywhere: bool, allowed: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """(start, number of the marker, surroundings) in order of place, without those in allowed surroundings."""
    made, tried = automaton(patterns, anywhere)
    behind, out = [0] * len(patterns), []
    starts = sorted((end - size + 1, k) for end, (size, ks) in made.iter(folded(text)) for k in ks)
    for start, k in starts:
        if start >= behind[k] and (m := tried[k].match(text, start)):
            behind[k] = m.end()
            around = text[max(0, start - RADIUS) : m.end() + RADIUS]
            if not any(a in around for a in allowed):
                out.append((start, k, around))
    return out


def scanned(language: Column, markers=REMNANT_MARKERS) -> Column:
    """Whether a language has markers."""
    return F.coalesce(F.lower(language).isin([lang for lang, _ in markers]), F.lit(False))


def _frozen(markers) -> Markers:
    return tuple((lang, tuple(found)) for lang, found in markers)


FOUND = "view string, kind string, marker string, place int, context string"


def scan(rows: DataFrame, language: str = "language", text: str = "text", deleted: str = "deleted_text", keys: tuple[str, ...] = ("doc_id", "idx"), least_words: int = 3, dense: int = 3, italian: bool = True, markers=REMNANT_MARKERS, allowed=ALLOWED_CONTEXTS) -> DataFrame:
    """keys, view (accept, reject), kind (remnant, dense), marker, place, context of the rows' two views."""
    table, allowed = dict(_frozen(markers)), tuple(allowed)
    source = rows.select(*keys, F.lower(F.col(language)).alias("__l"), F.col(text).alias("__t"), F.col(deleted).alias("__d")).where(scanned(F.col("__l"), markers))

    def findings(view: str, t: str | None, lang: str, least: int) -> list[tuple]:
        if t is None or len(t.split()) < least:
            return []
        found = hits(t, table[lang], lang in SUBSTRING_LANGUAGES, allowed)
        kept = [h for h in found if not italian or lang != "italian" or not ITALIAN_SURROUNDINGS.search(h[2].strip())]
        whole = [(view, "dense", None, 0, t[:SHOWN])] if len(found) >= dense else []
        return [(view, "remnant", table[lang][k], start, around.strip()[:SHOWN]) for start, k, around in kept] + whole

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "view", "kind", "marker", "place", "context"]
        for batch in batches:
            ids = list(batch[list(keys)].itertuples(index=False, name=None))
            made = [(*i, *f) for i, lang, t, d in zip(ids, batch["__l"], batch["__t"], batch["__d"]) for f in findings("accept", t, lang, least_words) + findings("reject", d, lang, 1)]
            yield pd.DataFrame(made, columns=names)

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInPandas(run, f"{schema}, {FOUND}")


def part_texts(parts: DataFrame, names: str = AUXILIARY) -> DataFrame:
    """path, part, idx, element (t, lvlText), text: text elements and numbering levels of auxiliary parts, one by one; ill-formed parts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, part, content in zip(batch["path"], batch["part"], batch["content"]):
                try:
                    found = [(n.tag, n.text if n.tag == "t" else n.get("val")) for n in tree(content).walk() if n.tag in ("t", "lvlText")]
                except ExpatError:
                    found = []
                rows += [(path, part, k, tag, text) for k, (tag, text) in enumerate(found) if text and text.strip()]
            yield pd.DataFrame(rows, columns=["path", "part", "idx", "element", "text"])

    return parts.where(F.col("part").rlike(f"^(?:{names})$") & F.col("content").isNotNull()).select("path", "part", "content").mapInPandas(run, "path string, part string, idx int, element string, text string")


def scan_parts(parts: DataFrame, language: DataFrame, markers=REMNANT_MARKERS, allowed=ALLOWED_CONTEXTS) -> DataFrame:
    """path, part, idx, element, marker, place, context in auxiliary parts; language (path, language) is the packages'."""
    texts = part_texts(parts).join(language.select("path", "language"), "path").withColumn("deleted_text", F.lit(None).cast("string"))
    keys = ("path", "part", "idx", "element")
    return scan(texts, keys=keys, least_words=1, dense=2**31, italian=False, markers=markers, allowed=allowed).drop("view", "kind")
