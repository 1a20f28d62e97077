"""Translations put back into parts: paragraphs are found by their texts, and edits by place write them.

``write_back`` is the whole way: the paragraphs of all parts, the queue of ``assignment.find_matches`` between them and the records, and one pass
over each part, which makes the edits of its paragraphs and sets them in place. A paragraph without revisions gets new runs in place of its texts, with the properties of its
first run, bold and italic told outright; anchors, drawings, fields, tabs and page breaks stay where they are. A paragraph with revisions
keeps its elements, authors and dates: each segment's text lies over the segment's text elements in proportion to what they held.

Defined cases: records with a blank text or translation, or a translation equal to the text and no segments, are counted and left out. A null
part means the main document. Segments whose kinds differ from the paragraph's are not used: its texts then lie over what is kept, and the
deleted ones over what is deleted. A part that can't be read stays as it is, with an error in the report.
"""

from __future__ import annotations

import re
from functools import lru_cache
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.functions.rules import DEFINITION_VERBS
from paragrid.functions.text import trimmed
from paragrid.operators.assignment import find_matches
from paragrid.operators.auxiliary import over_pieces
from paragrid.sources.markup import Node, kept_texts, own, paragraphs_of, piece, spliced
from paragrid.sources.packages import parts as parts_of
from paragrid.sources.packages import repack
from paragrid.sources.tables import as_dealt, map_rows, written

MAIN = "word/document.xml"
#: The order of run properties, and names in styles of headings.
PROPERTIES = "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern position sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath".split()
HEADINGS = ("heading", "cmsor", "title", "titre")
_PLACE = {t: k for k, t in enumerate(PROPERTIES)}
_TEXTS = ("t", "delText")
_PREFIX = re.compile(rb"<([^\s/>:]+:)?")
_TERM = re.compile(r"[“\"„]([^\"”“]+?)[”\"]\s*(?=" + "|".join(DEFINITION_VERBS) + ")", re.IGNORECASE)
_RECORD = "idx long, en string, en_deleted string, en_segments array<struct<type:string,en:string>>, en_runs array<struct<start:int,end:int,bold:boolean,italic:boolean>>, bold array<struct<text:string,bold:boolean>>"

Edit = tuple[int, int, bytes]


def _element(prefix: bytes, name: str, inner: bytes | None = None, attributes: bytes = b"") -> bytes:
    tag = prefix + name.encode()
    return b"<" + tag + attributes + (b"/>" if inner is None else b">" + inner + b"</" + tag + b">")


@lru_cache(1000)
def _off(prefix: bytes, name: str) -> bytes:
    return _element(prefix, name, None, b" " + prefix + b'val="0"')


@lru_cache(1000)
def _properties(prefix: bytes, properties: tuple[tuple[str | None, bytes], ...], bold: bool, italic: bool) -> bytes:
    """Run properties with bold and italic on or off."""
    made = list(properties)
    for name, on in (("b", bold), ("bCs", bold), ("i", italic), ("iCs", italic)):
        one = (name, _element(prefix, name) if on else _off(prefix, name))
        at = next((k for k, (tag, _) in enumerate(made) if tag == name), None)
        if at is None:
            made.insert(next((k for k, (tag, _) in enumerate(made) if _PLACE.get(tag, 99) > _PLACE[name]), len(made)), one)
        else:
            made[at] = one
    return _element(prefix, "rPr", b"".join(raw for _, raw in made))


class Paragraph:
    """A paragraph of a part with what edits need of it."""

    def __init__(self, xml: bytes, p: Node):
        self.xml, self.p, self.runs = xml, p, list(own(p))
        self.prefix = _PREFIX.match(xml, p.start)[1] or b""
        self.tracked = any(kind != "regular" for _, kind, _ in self.runs)

    @property
    def text(self) -> str:
        return "".join(piece(r) for r, kind, _ in self.runs if kind in ("regular", "ins"))

    def raw(self, node: Node) -> bytes:
        return self.xml[node.start : node.end]

    def element(self, name: str, inner: bytes | None = None, attributes: bytes = b"") -> bytes:
        return _element(self.prefix, name, inner, attributes)

    def off(self, name: str) -> bytes:
        return _off(self.prefix, name)

    def leaf(self, node: Node, text: str) -> Edit:
        """A text element with another text; its attributes stay."""
        tag = self.xml[node.start : node.inner].removesuffix(b"/>").removesuffix(b">").rstrip()
        if text[:1] == " " or text[-1:] == " ":
            tag += b"" if b"xml:space" in tag else b' xml:space="preserve"'
        return node.start, node.end, tag + b">" + escape(text).encode() + b"</" + self.prefix + node.tag.encode() + b">"

    def run(self, text: str, properties: list[tuple[str | None, bytes]], bold: bool, italic: bool) -> bytes:
        """A new run with bold and italic on or off, whatever its style says."""
        space = b' xml:space="preserve"' if text[:1] == " " or text[-1:] == " " else b""
        return self.element("r", _properties(self.prefix, tuple(properties), bold, italic) + self.element("t", escape(text).encode(), space))


def _formatting(en: str, en_runs, bold_runs) -> list[tuple[int, int, bool, bool]]:
    """(start, end, bold, italic): short texts whose source is all bold are; else the record's ranges; else terms before definition verbs are bold."""
    inked = [r for r in bold_runs if (r["text"] or "").strip()]
    if inked and all(r["bold"] for r in inked) and len(en.split()) <= 10:
        return [(0, len(en), True, False)]
    if len(en_runs):
        return [(r["start"] or 0, len(en) if r["end"] is None else r["end"], bool(r["bold"]), bool(r["italic"])) for r in en_runs]
    made, at = [], 0
    for m in _TERM.finditer(en):
        made += [(at, m.start(1), False, False), (m.start(1), m.end(1), True, False)]
        at = m.end(1)
    return [*made, (at, len(en), False, False)]


def _plain(x: Paragraph, record) -> list[Edit]:
    """Edits of a paragraph without revisions."""
    lone = ("t", "br", "cr", "tab", "rPr", "lastRenderedPageBreak", "noBreakHyphen", "softHyphen")
    edits, links = [], {}
    for r, _, top in x.runs:
        link = next((n for n in ([top, *top.walk()] if top.tag == "hyperlink" or top.children else []) if n.tag == "hyperlink" and n.start <= r.start < n.end), None)
        texts = [c for c in r.children if c.tag == "t"]
        bearing = any(c.text for c in texts)
        if link is not None:
            if link.start not in links:
                links[link.start] = (link.start, link.end, True)
                edits.append(links[link.start])
        elif bearing and all(c.tag in lone for c in r.children):
            edits.append((r.start, r.end, True))
        elif bearing:  # its anchors stay
            edits += [(c.start, c.end, True) for c in r.children if c.tag in ("t", "br", "cr", "tab") and c.get("type") != "page"]
        elif all(c.tag in ("t", "rPr", "br", "cr") and c.get("type") != "page" for c in r.children):
            edits.append((r.start, r.end, False))
    if not edits and x.p.end == x.p.inner:
        return []
    first = next((r for r, _, top in x.runs if top is r and any(c.tag == "t" and c.text.strip() for c in r.children) and r.child("rPr") is not None), None)
    properties = [(c.tag, x.raw(c)) for c in first.child("rPr").children if c.tag != "lang"] if first is not None else []
    new = b""
    for start, end, bold, italic in _formatting(record["en"], record["en_runs"], record["bold"]):
        for part in re.split(r"([\t\n])", record["en"][start:end]):
            new += x.element("r", x.element("tab" if part == "\t" else "br")) if part in ("\t", "\n") else x.run(part, properties, bold, italic) if part else b""
    place = next(((s, e) for s, e, bearing in edits if bearing), (x.p.close, x.p.close))
    holder = next((r for r, _, _ in x.runs if r.start < place[0] < r.end), None)
    if holder is not None:  # the first text stands in a run whose anchors stay: new runs come before it
        return [(holder.start, holder.start, new), *((s, e, b"") for s, e, _ in edits)]
    return [(*place, new), *((s, e, b"") for s, e, _ in edits if (s, e) != place)]


def _segments(x: Paragraph) -> list[dict]:
    """Neighbouring runs of one kind: kind, their text elements, and at which of these another child of the paragraph begins."""
    made, last = [], None
    for r, kind, top in x.runs:
        if not piece(r):
            continue
        leaves = [c for c in r.children if c.tag in _TEXTS]
        if made and made[-1]["kind"] == kind:
            if top is not last:
                made[-1]["joints"].append(len(made[-1]["leaves"]))
            made[-1]["leaves"] += leaves
        else:
            made.append({"kind": kind, "leaves": leaves, "joints": []})
        last = top
    return made


def _laid(leaves: list[Node], text: str) -> dict[int, str]:
    return dict(zip([n.start for n in leaves], over_pieces([n.text for n in leaves], text)))


def _bare(text: str) -> str:
    return text.replace("​", "").strip()


def _tracked(x: Paragraph, record) -> list[Edit]:
    """Edits of a paragraph with revisions."""
    new: dict[int, str] = {}
    wanted, found = record["en_segments"], _segments(x)
    if len(wanted) and [s["type"] for s in wanted] == [s["kind"] for s in found]:
        for want, have in zip(wanted, found):
            if want["en"] is None or not have["leaves"]:
                continue
            if not want["en"].strip():
                new |= {n.start: "" for n in have["leaves"]}
                continue
            new |= _laid(have["leaves"], want["en"])
            for k in have["joints"]:  # a zero-width blank keeps two pieces of one word from being taken for two words
                if 0 < k < len(have["leaves"]):
                    before, at = new[have["leaves"][k - 1].start], have["leaves"][k].start
                    if before[-1:].isalpha() and new[at][:1].isalpha():
                        new[at] = "​" + new[at]
    else:
        leaves = lambda kinds: [c for r, kind, _ in x.runs if kind in kinds for c in r.children if c.tag in _TEXTS]
        new |= _laid(leaves(("regular", "ins")), record["en"])
        new |= _laid(leaves(("del", "ins_then_del")), record["en_deleted"] or "")
    nodes = {c.start: c for r, _, _ in x.runs for c in r.children if c.tag in _TEXTS}
    marked = {c.start: "".join(new.get(n.start, n.text) for n in c.walk() if n.tag in _TEXTS) for c in x.p.children if c.tag in ("ins", "del")}
    text_of = lambda node: marked[node.start]
    gone, edits = [], []
    children, k = x.p.children, 0
    while k < len(children):  # an insertion and a deletion of one text side by side are no change in this language
        a, b = children[k], children[k + 1] if k + 1 < len(children) else None
        if b is not None and {a.tag, b.tag} == {"ins", "del"} and _bare(text_of(a)) and _bare(text_of(a)) == _bare(text_of(b)):
            edits.append((a.start, b.end, x.element("r", x.element("t", escape(_bare(text_of(a))).encode()))))
            gone += [a.start, b.start]
            k += 1
        k += 1
    for k, c in enumerate(children):  # white space in revisions goes to the next regular run, before it or else behind it
        blank = text_of(c) if c.tag in ("ins", "del") and c.start not in gone else ""
        if not blank or blank.strip() or "​" in blank:
            continue
        for others, end in ((children[k - 1 :: -1] if k else [], -1), (children[k + 1 :], 0)):
            run = next((o for o in others if o.tag == "r"), None)
            texts = [n for n in run.walk() if n.tag == "t"] if run is not None else []
            if texts:
                old = new.get(texts[end].start, texts[end].text)
                new[texts[end].start] = old + blank if end else blank + old
                edits.append((c.start, c.end, b""))
                break
    edits += [x.leaf(nodes[s], t) for s, t in new.items() if t != nodes[s].text]
    style = next((n.get("val") or "" for n in (x.p.child("pPr").walk() if x.p.child("pPr") else []) if n.tag == "pStyle"), "").lower()
    heading = any(h in style for h in HEADINGS) and len("".join(n.text for n in x.p.walk() if n.tag == "t").strip()) < 120
    inked = [r for r in record["bold"] if r["text"]]
    if not heading and not any(r["bold"] for r in record["en_runs"]) and not (inked and all(r["bold"] for r in inked)):
        edits += [_unbold(x, r) for r, _, _ in x.runs]
    return edits


def _unbold(x: Paragraph, r: Node) -> Edit:
    """A run's bold told off, at its place among the run's properties."""
    of = r.child("rPr")
    if of is None or of.end == of.inner:
        start, end = (r.inner, r.inner) if of is None else (of.start, of.end)
        return start, end, x.element("rPr", x.off("b"))
    b = of.child("b")
    if b is not None:
        return b.start, b.end, x.off("b")
    at = next((c.start for c in of.children if _PLACE.get(c.tag, 99) > _PLACE["b"]), of.close)
    return at, at, x.off("b")


def texts(parts: DataFrame) -> DataFrame:
    """path, part, idx, text, error: all paragraphs of parts, with the text that is kept when revisions are accepted."""

    def of_part(path: str, part: str, content: bytes) -> list[tuple]:
        try:
            return [(path, part, k, t, None) for k, t in enumerate(kept_texts(content))]
        except ExpatError as e:
            return [(path, part, None, None, str(e))]

    return map_rows(parts.select("path", "part", "content"), of_part, "path string, part string, idx long, text string, error string")


def edited(parts: DataFrame, assigned: DataFrame) -> DataFrame:
    """path, part, content, error: the parts that records (doc, path, part and the fields of _RECORD) change, with the edits of their paragraphs in place.

    A part's records come to it sorted out by ``doc``, and its edits are made and spliced in one pass."""
    fields = F.struct(*[f.split()[0] for f in _RECORD.split(", ")])
    gathered = assigned.groupBy("doc", "path", "part").agg(F.collect_list(fields).alias("records"))
    dealt = parts.where("content is not null").select(F.concat_ws("\n", "path", "part").alias("doc"), "path", "part", "content").repartition("doc")
    joined = dealt.join(gathered, ["doc", "path", "part"]).select("path", "part", "content", "records")

    def of_part(path: str, part: str, content: bytes, records: list[dict]) -> list[tuple]:
        found, edits = paragraphs_of(content), []
        for record in records:
            x = Paragraph(content, found[record["idx"]])
            edits += _tracked(x, record) if x.tracked else _plain(x, record)
        return [(path, part, *spliced(content, edits))] if edits else []

    return map_rows(joined, of_part, "path string, part string, content binary, error string", 200)


def write_back(parts: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, part, content, error) of the parts that changed, and the report: a row of path, part, idx, match_idx, status for each record.

    records: path, part, idx, text, en, en_deleted, en_segments, en_runs, runs, as extraction and translation leave them. status is
    applied, moved (found at another place), missing, same, empty."""
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    same = (F.coalesce(F.size("en_segments"), F.lit(0)) <= 0) & (trimmed(F.col("text")) == trimmed(F.col("en")))
    keyed = records.withColumn("part", F.coalesce("part", F.lit(MAIN))).withColumn("doc", F.concat_ws("\n", "path", "part"))
    sorted_out = keyed.withColumn("left_out", F.when(blank("text") | blank("en"), "empty").when(same, "same"))
    there = texts(parts).where("error is null").withColumn("doc", F.concat_ws("\n", "path", "part"))
    matched = find_matches(sorted_out.where("left_out is null"), there, doc="doc").withColumnRenamed("doc_id", "doc")
    matched = written(matched, "matched")
    report = sorted_out.join(matched, ["doc", "idx"], "left").withColumn("status", F.coalesce("left_out", F.when(F.col("match_idx").isNull(), "missing").when(F.col("match_idx") == F.col("idx"), "applied").otherwise("moved")))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    runs = F.transform(none("runs", records.schema["runs"].dataType), lambda r: F.struct(r["text"].alias("text"), r["bold"].alias("bold")))
    dealt = sorted_out.where("left_out is null").repartition("doc").join(matched.repartition("doc"), ["doc", "idx"])
    assigned = dealt.select("doc", "path", "part", F.col("match_idx").alias("idx"), trimmed(F.col("en")).alias("en"), trimmed(F.col("en_deleted")).alias("en_deleted"), none("en_segments", "array<struct<type:string,en:string>>").alias("en_segments"), none("en_runs", "array<struct<start:int,end:int,bold:boolean,italic:boolean>>").alias("en_runs"), runs.alias("bold"))
    with as_dealt(parts.sparkSession):
        changed = written(edited(parts, assigned), "changed")
    return changed, report.select("path", "part", "idx", "match_idx", "status")


def apply_to_packages(packages: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, content, error) of the packages with their translations, and the report of ``write_back``."""
    found = parts_of(packages).where("error is null")
    asked = records.select("path", F.coalesce("part", F.lit(MAIN)).alias("part")).distinct()
    written, report = write_back(found.join(asked, ["path", "part"], "left_semi"), records)
    return repack(found, written.where("error is null")), report
