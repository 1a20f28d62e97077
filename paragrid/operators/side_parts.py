"""Headers, footers and comments: rows for translators, and translations put back by place.

A header's paragraph with fields (page numbers, dates) is told as its text with a mark like <<PAGE>> for each field's result. Put back, the text
between two marks goes into the first run of that zone and empties the others; what belongs to fields, instructions and results alike, stays byte
for byte. A paragraph without fields gets its translation in its first text element. All runs, properties and tabs stay.

Defined cases: translations that are null, blank or equal to the text leave a paragraph as it is; with too few marks the last zones become
empty, with too many the rest joins the last zone; text for a zone without a run is left out, as there is nothing to hold it. A paragraph place or comment
that the part doesn't have changes nothing. A part that can't be read has no rows and stays.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.parsers.expat import ExpatError
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragrid.sources.markup import EDIT, Node, own, paragraphs_of, splice, tree
from paragrid.sources.tables import map_rows, written

SIDE, COMMENTS = r"word/(?:header|footer)[^/]*\.xml", "word/comments.xml"
_MARK = re.compile(r"<<[A-Z][A-Z0-9_]*>>")
FIELDS = "array<struct<type:string,cached_result:string>>"
Edits = list[tuple[int, int, bytes]]
#: Edits with the number of the paragraph that each is for.
NUMBERED = EDIT + ", unit long"


def roles(p: Node) -> list[tuple[str, str | None, Node | None]]:
    """(role, field type, text element) of a paragraph's own runs in order, by an automaton over begin, separate and end.

    Roles: text, result (of a field), begin, instruction, separate, end, other."""
    made, state, kind = [], "outside", None
    for r, _, _ in own(p):
        mark, instruction, t = r.child("fldChar"), r.child("instrText"), r.child("t")
        if mark is not None:
            role = mark.get("fldCharType") or ""
            if role == "begin":
                state, kind = "instruction", None
            made.append((role if role in ("begin", "separate", "end") else "other", kind, None))
            if role == "separate":
                state = "result"
            elif role == "end":
                state, kind = "outside", None
        elif instruction is not None and state != "outside":
            kind = kind or next(iter(instruction.text.split()), "").upper() or None
            made.append(("instruction", kind, None))
        elif t is not None and t.text:
            made.append(({"outside": "text", "result": "result"}.get(state, "other"), kind, t))
        else:
            made.append(("other", kind, None))
    return made


def told(p: Node) -> tuple[str, list[tuple[str, str]]]:
    """A paragraph's text with a mark for each field's result, and the fields; all own text where there are no fields."""
    found = roles(p)
    if not any(role in ("begin", "instruction", "separate", "end", "result") for role, _, _ in found):
        return "".join(c.text for r, _, _ in own(p) for c in r.children if c.tag == "t"), []
    shown = "".join(t.text if role == "text" else f"<<{kind or 'FIELD'}>>" for role, kind, t in found if role in ("text", "result"))
    return shown, [(kind or "FIELD", t.text) for role, kind, t in found if role == "result"]


def _set(xml: bytes, t: Node, text: str, preserve: bool = True) -> tuple[int, int, bytes]:
    """A text element with another text, its blanks kept."""
    head = xml[t.start : t.inner].removesuffix(b"/>").removesuffix(b">").rstrip()
    name = re.match(rb"<([^\s/>]+)", head)[1]
    space = b' xml:space="preserve"' if preserve and b"xml:space" not in head else b""
    return t.start, t.end, head + space + b">" + escape(text).encode() + b"</" + name + b">"


def zone_edits(xml: bytes, p: Node, en: str) -> Edits:
    """Edits that lay a translation with marks over the zones between fields."""
    found, zone, zones = roles(p), 0, {}
    for role, _, t in found:
        zone += role == "end"
        if role == "text":
            zones.setdefault(zone, []).append(t)
    n = sum(role == "begin" for role, _, _ in found)
    pieces = _MARK.split(en)
    pieces = [*pieces[:n], "".join(pieces[n:])] if len(pieces) > n else pieces + [""] * (n + 1 - len(pieces))
    return [_set(xml, t, piece if k == 0 else "") for z, piece in enumerate(pieces) for k, t in enumerate(zones.get(z, []))]


def text_edits(xml: bytes, p: Node, en: str) -> Edits:
    """Edits that put a translation into the first text element and empty the others."""
    leaves = [c for r, _, _ in own(p) for c in r.children if c.tag == "t"]
    return [_set(xml, t, "" if k else en, not k) for k, t in enumerate(leaves)]


def _over_parts(joined: DataFrame, of_part: Callable[[bytes, object], Iterator[tuple[int, tuple]]], extra: str) -> DataFrame:
    """Edits of parts (path, part, content, ``extra``) by a function of the content and the extra column, which gives (unit, edit)."""

    def edits_of(path: str, part: str, content: bytes, more) -> list[tuple]:
        try:
            return [(path, part, *e, unit) for unit, e in of_part(content, more)]
        except ExpatError:
            return []

    return map_rows(joined.select("path", "part", "content", extra), edits_of, NUMBERED)


def side_rows(parts: DataFrame) -> DataFrame:
    """path, idx, source, p_idx, text, fields: paragraphs of headers and footers that aren't blank, numbered over each package."""

    def of_part(path: str, part: str, content: bytes) -> list[tuple]:
        try:
            return [r for k, p in enumerate(paragraphs_of(content)) if (r := (path, part, k, *told(p)))[3].strip()]
        except ExpatError:
            return []

    found = map_rows(parts.where(F.col("part").rlike(f"^{SIDE}$") & F.col("content").isNotNull()).select("path", "part", "content"), of_part, f"path string, source string, p_idx int, text string, fields {FIELDS}")
    return found.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("source", "p_idx")) - 1).alias("idx"), "source", "p_idx", "text", "fields")


def apply_side_rows(parts: DataFrame, entries: DataFrame) -> DataFrame:
    """path, part, content, error, n: the headers and footers that entries (path, source, p_idx, text, en, fields) name, and how many paragraphs changed.

    Parts whose entries leave all as it is come back as they are."""
    usable = F.col("en").isNotNull() & (F.regexp_replace("en", r"(?U)^\s+|\s+$", "") != "") & ~F.col("en").eqNullSafe(F.col("text"))
    one = F.struct("p_idx", "en", (F.coalesce(F.size("fields"), F.lit(0)) > 0).alias("with_fields"))
    wanted = entries.groupBy("path", F.col("source").alias("part")).agg(F.collect_list(F.when(usable, one)).alias("wanted"))
    joined = parts.where("content is not null").join(wanted, ["path", "part"])

    def of_part(content: bytes, wanted) -> Iterator[tuple[int, tuple]]:
        found = paragraphs_of(content)
        for w in {w["p_idx"]: w for w in wanted}.values():
            if w["p_idx"] < len(found):
                yield from ((w["p_idx"], e) for e in (zone_edits if w["with_fields"] else text_edits)(content, found[w["p_idx"]], w["en"]))

    edits = written(_over_parts(joined, of_part, "wanted"), "edits")  # read twice
    changed = splice(parts, edits.drop("unit")).join(edits.groupBy("path", "part").agg(F.countDistinct("unit").alias("n")), ["path", "part"])
    made = changed.select("path", "part", F.col("content").alias("made"), "error", "n")
    return joined.select("path", "part", "content").join(made, ["path", "part"], "left").select("path", "part", F.coalesce("made", "content").alias("content"), "error", F.coalesce("n", F.lit(0)).alias("n"))


def apply_comments(parts: DataFrame, translations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, part, content, error) of the comment parts that change, and path, id, status of all comments: translated, untranslated, empty.

    A translation (path, id, en) goes into a comment's first text element; its other texts, deleted ones too, become empty. The last of
    several for one comment counts in the order of their texts; null is none."""
    ours = parts.where(F.col("part") == COMMENTS).where("content is not null")
    given = translations.where("en is not null").groupBy("path", "id").agg(F.max("en").alias("en")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("id", "en"))).alias("given"))
    joined = ours.join(given, "path", "left").withColumn("given", F.coalesce("given", F.create_map().cast("map<string,string>")))

    def comments_of(content: bytes) -> list[tuple[str | None, list[Node]]]:
        root = tree(content)
        return [(c.get("id"), [n for n in c.walk() if n.tag in ("t", "delText")]) for c in [root, *root.walk()] if c.tag == "comment"]

    def of_part(content: bytes, given) -> Iterator[tuple[int, tuple]]:
        given = dict(given)
        for unit, (of, leaves) in enumerate(comments_of(content)):
            first = next((n for n in leaves if n.tag == "t"), None)
            if of in given and first is not None:
                yield from ((unit, _set(content, n, given[of] if n is first else "", n is first)) for n in leaves)

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, given in zip(batch["path"], batch["content"], batch["given"]):
                try:
                    found = comments_of(content)
                except ExpatError:
                    continue
                for of, leaves in found:
                    texts = [n for n in leaves if n.tag == "t"]
                    rows.append((path, of, "translated" if of in dict(given) and texts else "untranslated" if "".join(n.text for n in texts).strip() else "empty"))
            yield pd.DataFrame(rows, columns=["path", "id", "status"])

    return splice(ours, _over_parts(joined, of_part, "given").drop("unit")), joined.select("path", "content", "given").mapInPandas(states, "path string, id string, status string")


def term_edits(content: bytes, terms: list[tuple[str, str]]) -> Edits:
    """Edits that replace known terms, the longest first, in all texts; a term that two neighbouring runs hold between them makes one run of
    them, and takes a colon in the run behind with it."""
    longest, out, texts = sorted(terms, key=lambda t: -len(t[0])), [], {}
    for p in paragraphs_of(content):
        runs, k = [c for c in p.children if c.tag == "r"], 0
        text = lambda r: texts.get(r.child("t").start, r.child("t").text) if r.child("t") is not None else ""
        while k < len(runs) - 1:
            a, b = text(runs[k]), text(runs[k + 1])
            hit = next((t for t in longest if a and b and t[0].lower() in (a + b).lower() and t[0].lower() not in a.lower() and t[0].lower() not in b.lower()), None)
            if hit is None:
                k += 1
                continue
            colon = k + 2 < len(runs) and text(runs[k + 2]).strip() == ":"
            texts[runs[k].child("t").start] = hit[1] + (":" if colon and not hit[1].endswith(":") else "")
            gone = runs[k + 1 : k + 2 + (colon and not hit[1].endswith(":"))]
            out += [(r.start, r.end, b"") for r in gone]
            del runs[k + 1 : k + 1 + len(gone)]
    root = tree(content)
    for t in [n for n in [root, *root.walk()] if n.tag == "t"]:
        made = texts.get(t.start, t.text)
        for source, target in longest:
            made = made.replace(source, target)
        if made != t.text:
            out.append(_set(content, t, made, made[:1] == " " or made[-1:] == " " or t.start in texts))
    return out


def translate_terms(parts: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """path, part, content, error of the headers and footers in which known terms are replaced."""
    ours = parts.where(F.col("part").rlike(f"^{SIDE}$")).where("content is not null").withColumn("more", F.lit(0))
    return splice(ours, _over_parts(ours, lambda content, _: ((0, e) for e in term_edits(content, terms)), "more").drop("unit"))
