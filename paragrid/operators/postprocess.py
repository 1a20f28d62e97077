"""All passes over the paragraphs of parts, within pieces of text and across them, written back by place.

``scan`` gives a row per paragraph with its pieces (text elements) and the places of line breaks, italics and page breaks; ``with_passes`` runs
the passes over the array of a paragraph's pieces as columns, each pass a lambda over a one-element array so that the plan grows with their
number; ``edits`` turns what changed into edits by place. A pass across pieces sees the pieces before as a fold over the array does: a missing
blank, a definition verb glued to a term, a word repeated over a joint, citations whose target stands in a later piece, and quotes that are
still open before a definition verb.

Defined cases: a paragraph without text has no pieces and no edits; a part that can't be read has no rows. Texts within paragraphs that lie in
others (text boxes) belong to the inner ones.
"""

from __future__ import annotations

from collections.abc import Callable
from xml.parsers.expat import ExpatError

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.functions.rules import DEFINITION_VERBS
from paragrid.functions.text import needs_space, trimmed
from paragrid.operators import normalize
from paragrid.operators.formatting import LATIN_TERMS
from paragrid.sources.markup import Node, own, paragraphs_of, splice
from paragrid.sources.tables import map_rows

PIECE = "struct<tag:string,text:string,start:long,end:long,head:binary,tail:binary>"
PARAGRAPH = f"path string, part string, idx long, style string, italic boolean, pieces array<{PIECE}>, breaks array<struct<start:long,end:long>>, italics array<struct<piece:int,start:long,end:long>>, page struct<place:long,content:binary>"
VERBS = "|".join(DEFINITION_VERBS)
#: Styles of body text that only mention schedules, and the paragraph properties that come before a page break.
MENTIONING_STYLES = ["FWBL2", "FWBL3", "FWBL4", "FWBL5", "FWBCont1", "FWBCont2", "FWBCont3", "Normal"]
_BEFORE_BREAK = ("pStyle", "keepNext", "keepLines", "pageBreakBefore")
OFF = ("0", "false", "off")
Pieces = Callable[[Column], Column]


def _is_on(node: Node | None) -> bool:
    return node is not None and (node.get("val") or "true").strip().lower() not in OFF


def _row(xml: bytes, p: Node) -> tuple:
    name = xml[p.start + 1 : p.inner].split(None, 1)[0].rstrip(b"/>")
    prefix = name[: name.index(b":") + 1] if b":" in name else b""
    pieces, breaks, italics = [], [], []
    for r, _, _ in own(p):
        first = next((c for c in r.children if c.tag == "br"), None)
        if first is not None:
            breaks.append((first.start, first.end))
        i = next((c for c in (r.child("rPr").children if r.child("rPr") else []) if c.tag == "i"), None)
        if _is_on(i) and r.child("t") is not None:
            italics.append((len(pieces) + sum(c.tag == "delText" for c in r.children[: r.children.index(r.child("t"))]), i.start, i.end))
        for c in r.children:
            if c.tag in ("t", "delText"):
                head = xml[c.start : c.inner].removesuffix(b"/>").removesuffix(b">").rstrip()
                pieces.append((c.tag, c.text, c.start, c.end, head, b"</" + prefix + c.tag.encode() + b">"))
    of = p.child("pPr")
    page = None
    if of is None:
        page = (p.inner, b"<" + prefix + b"pPr><" + prefix + b"pageBreakBefore/></" + prefix + b"pPr>") if p.end > p.inner else None
    elif of.end > of.inner and of.child("pageBreakBefore") is None:
        page = (next((c.start for c in of.children if c.tag not in _BEFORE_BREAK), of.close), b"<" + prefix + b"pageBreakBefore/>")
    style = of.child("pStyle") if of is not None else None
    props = of.child("rPr") if of is not None else None
    return style.get("val") if style is not None else None, _is_on(props.child("i") if props is not None else None), pieces, breaks, italics, page


def scan(parts: DataFrame) -> DataFrame:
    """A row (PARAGRAPH) for each paragraph with text elements."""

    def of_part(path: str, part: str, content: bytes) -> list[tuple]:
        try:
            found = paragraphs_of(content)
        except ExpatError:
            return []
        return [(path, part, k, *row) for k, p in enumerate(found) if (row := _row(content, p))[2]]

    return map_rows(parts.where("content is not null").select("path", "part", "content"), of_part, PARAGRAPH)


def _before(ps: Column, i: Column, kept: Callable[[Column], Column]) -> Column:
    """The text of the last piece before place i that is kept; null for none."""
    return F.try_element_at(F.filter(F.slice(ps, F.lit(1), i), kept), F.lit(-1))["text"]


def _with(p: Column, text: Column) -> Column:
    return F.struct(p["tag"].alias("tag"), text.alias("text"))


def _shown(p: Column) -> Column:
    return (p["tag"] == "t") & (p["text"] != "")


def each(step: Callable[[Column], Column]) -> Pieces:
    """A pass within pieces of what is shown."""
    return lambda ps: F.transform(ps, lambda p: _with(p, F.when(_shown(p), step(p["text"])).otherwise(p["text"])))


def spacing(ps: Column) -> Column:
    """A blank before a piece that would run into the one before, deleted ones too."""
    missing = lambda p, i: F.coalesce((p["text"] != "") & needs_space(_before(ps, i, lambda q: q["text"] != ""), p["text"]), F.lit(False))
    return F.transform(ps, lambda p, i: _with(p, F.when(missing(p, i), F.concat(F.lit(" "), p["text"])).otherwise(p["text"])))


def verbs_apart(ps: Column) -> Column:
    """A blank between a piece and a definition verb that begins the next."""
    glued = lambda p, i: F.coalesce(_shown(p) & ~F.endswith(_before(ps, i, _shown), F.lit(" ")) & p["text"].rlike(rf"^(?:{VERBS})\b"), F.lit(False))
    return F.transform(ps, lambda p, i: _with(p, F.when(glued(p, i), F.concat(F.lit(" "), p["text"])).otherwise(p["text"])))


def articles(to: str) -> Pieces:
    """Citations within pieces, whose targets are looked for in the whole paragraph."""

    def run(ps: Column) -> Column:
        shown = lambda upto: F.array_join(F.transform(F.filter(upto, lambda p: p["tag"] == "t"), lambda p: p["text"]), "")
        made = lambda joined: F.transform(ps, lambda p, i: _with(p, F.when(_shown(p), normalize.internal_articles(p["text"], to, joined, F.length(shown(F.slice(ps, F.lit(1), i))))).otherwise(p["text"])))
        return F.transform(F.array(shown(ps)), made)[0]

    return run


def doubled_apart(ps: Column) -> Column:
    """The first word of a piece goes where it is the last word of the piece before (three letters or more, case and punctuation aside)."""
    inked = lambda p: (p["tag"] == "t") & p["text"].rlike(r"(?U)\S")

    def doubled(p: Column, i: Column) -> Column:
        ends = F.regexp_replace(F.regexp_extract(_before(ps, i, inked), r"(?U)(\S+)\s*\z", 1), r"[,;:.\"')\]]+$", "")
        begins = F.regexp_replace(F.regexp_extract(p["text"], r"(?U)^\s*(\S+)", 1), r"^[\"'(\[]+", "")
        return F.coalesce(inked(p) & (F.lower(ends) == F.lower(begins)) & ends.rlike(r"^\p{L}{3,}$"), F.lit(False))

    return F.transform(ps, lambda p, i: _with(p, F.when(doubled(p, i), F.regexp_replace(p["text"], r"(?U)^\s*\S+\s*", " ")).otherwise(p["text"])))


def quotes_closed(ps: Column) -> Column:
    """A quote still open at the end of a piece is closed there, if one of the next two pieces, the first with text, begins with a definition
    verb. The fold counts open quotes with those that it has closed itself."""
    ts = F.filter(ps, lambda p: p["tag"] == "t")
    count = lambda t, what: F.regexp_count(t, F.lit(what))

    def step(state: Column, p: Column) -> Column:
        k = state["k"]
        following = F.try_element_at(F.filter(F.slice(ts, k + 2, 2), lambda q: q["text"] != ""), F.lit(1))["text"]
        verb = F.coalesce(F.regexp_replace(following, r"(?U)^\s+", "").rlike(rf"^(?:{VERBS})\b"), F.lit(False))
        bare = F.regexp_replace(p["text"], r"(?U)\s+\z", "")
        still_open = state["open"] + count(p["text"], "[“„]") - count(p["text"], "”")
        closes = (p["text"] != "") & ~bare.rlike("[”\"]\\z") & verb & (still_open > 0)
        shown = F.struct((k + 1).alias("k"), (still_open - F.when(closes, 1).otherwise(0)).alias("open"), F.concat(state["out"], F.array(_with(p, F.when(closes, F.concat(bare, F.lit("”"))).otherwise(p["text"])))).alias("out"))
        return F.when(p["tag"] == "t", shown).otherwise(F.struct(k.alias("k"), state["open"].alias("open"), F.concat(state["out"], F.array(p)).alias("out")))

    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("open"), F.array().cast("array<struct<tag:string,text:string>>").alias("out"))
    whole = F.array_join(F.transform(ts, lambda p: p["text"]), "")
    return F.when(whole.rlike(VERBS), F.aggregate(ps, start, step, lambda s: s["out"])).otherwise(ps)


def passes(variant: str = "uk", tree: str = "uk") -> list[tuple[str, Pieces]]:
    """The passes over a paragraph's pieces in order."""
    wide = tree == "us"
    return [
        ("spacing", spacing),
        ("definition_boundaries", lambda ps: F.transform(F.array(each(normalize.definition_boundaries)(ps)), verbs_apart)[0]),
        ("double_punctuation", each(normalize.double_punctuation)),
        ("terminology", each(normalize.terminology)),
        ("spelling", each(normalize.spelling(variant, wide))),
        ("annexes", each(normalize.annexes)),
        ("internal_articles", articles("Section" if wide and variant == "us" else "Clause")),
        ("doubled_words", lambda ps: F.transform(F.array(each(normalize.doubled_words)(ps)), doubled_apart)[0]),
        ("quotes", quotes_closed),
    ]


def schedule_heading(text: Column, style: Column) -> Column:
    """Short headings of schedules, whose label has no small letter, and whose style is none of body text or of a list of contents."""
    t = trimmed(text)
    label = F.regexp_replace(F.regexp_extract(t, r"(?iU)^(?:schedule|annex|allegato)\s+(\S+)", 1), r"[:,;.\-—–]+\z", "")
    named = t.rlike(r"(?iU)^(?:schedule|annex|allegato)\s+[\dA-Za-z]") & (F.length(t) <= 120) & ~label.rlike(r"\p{Ll}")
    return named & ~F.coalesce(style.isin(MENTIONING_STYLES) | F.upper(style).startswith("TOC"), F.lit(False))


def _stepped(step: Pieces) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["ps"].alias("was"), step(s["ps"]).alias("ps"), s["changed"].alias("changed"))


def _noted(name: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["ps"].alias("ps"), F.when(s["was"] == s["ps"], s["changed"]).otherwise(F.array_append(s["changed"], F.lit(name))).alias("changed"))


def with_passes(paragraphs: DataFrame, steps: list[tuple[str, Pieces]] | None = None) -> DataFrame:
    """paragraphs with after, the pieces' texts after all passes, full, what is shown then, and changed, the names of the passes that changed it."""
    bare = F.transform("pieces", lambda p: F.struct(p["tag"].alias("tag"), p["text"].alias("text")))
    now = F.array(F.struct(bare.alias("ps"), F.array().cast("array<string>").alias("changed")))
    for name, step in passes() if steps is None else steps:
        now = F.transform(F.transform(now, _stepped(step)), _noted(name))
    made = paragraphs.withColumn("__done", now[0])
    after = F.transform("__done.ps", lambda p: p["text"])
    full = F.array_join(F.transform(F.filter("__done.ps", lambda p: p["tag"] == "t"), lambda p: p["text"]), "")
    return made.withColumns({"after": after, "full": full, "changed": F.col("__done.changed")}).drop("__done")


def edits(passed: DataFrame) -> DataFrame:
    """path, part, start, end, content, kind: new texts of pieces, line breaks that leave definitions, italics that go, page breaks that come."""
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).cast("binary")
    edge = lambda z: z["new"].rlike("^ | \\z") & (F.position(F.lit(b"xml:space"), z["p"]["head"]) == 0)
    none, lit = F.lit(b""), lambda kind: F.lit(kind).alias("kind")
    edit = lambda start, end, content, kind: F.struct(start.alias("start"), end.alias("end"), content.alias("content"), lit(kind))
    pairs = F.filter(F.transform("pieces", lambda p, i: F.struct(p.alias("p"), F.col("after")[i].alias("new"))), lambda z: z["new"] != z["p"]["text"])
    texts = F.transform(pairs, lambda z: edit(z["p"]["start"], z["p"]["end"], F.concat(z["p"]["head"], F.when(edge(z), F.lit(b' xml:space="preserve"')).otherwise(none), F.lit(b">"), escaped(z["new"]), z["p"]["tail"]), "text"))
    definition = F.col("full").rlike(VERBS) & F.col("full").rlike("[“\"„]")
    breaks = F.when(definition, F.transform("breaks", lambda b: edit(b["start"], b["end"], none, "line_break"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,content:binary,kind:string>>"))
    words = lambda t: F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    heading = (trimmed(F.col("full")) == F.upper(trimmed(F.col("full")))) & (words(F.col("full")) < 10)

    def upright(i: Column) -> Column:
        t = trimmed(F.col("after")[i["piece"]])
        latin = F.exists(F.array(*map(F.lit, LATIN_TERMS)), lambda w: F.contains(F.lower(t), w))
        return (words(t) > 2) & ~(t.startswith("(") & t.endswith(")")) & ~latin

    italics = F.transform(F.filter("italics", lambda i: ~F.col("italic") & ~heading & upright(i)), lambda i: edit(i["start"], i["end"], none, "italic"))
    page = F.when(F.col("page").isNotNull() & schedule_heading(F.col("full"), F.col("style")), F.array(edit(F.col("page.place"), F.col("page.place"), F.col("page.content"), "page_break"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,content:binary,kind:string>>"))
    made = passed.select("path", "part", F.inline_outer(F.concat(texts, breaks, italics, page)))
    return made.where("kind is not null")  # the inner form would compute all passes again in a filter, once for each mention of their result


def post_process(parts: DataFrame, variant: str = "uk", tree: str = "uk") -> tuple[DataFrame, DataFrame]:
    """(path, part, content, error) of the parts that change, and path, part, pass, n: how many paragraphs or places each pass changed."""
    passed = with_passes(scan(parts), passes(variant, tree))
    made = edits(passed)
    counts = passed.select("path", "part", F.explode_outer("changed").alias("pass")).where("pass is not null").unionByName(made.where("kind <> 'text'").select("path", "part", F.col("kind").alias("pass"))).groupBy("path", "part", "pass").agg(F.count("*").alias("n"))
    return splice(parts, made.drop("kind")), counts
