"""Definition blocks: finding them, grouping their rows, putting them in order.

A document has one block at most. It is found by windows over the document's rows: starts of definitions that stand close together, else a
heading with definitions behind it. Rows may have a style and runs (of text and bold); where these are not named, texts alone decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrid.functions.rules import BOLD_NO_TERM_STARTS, BOLD_NO_TERMS, HEADING_STYLES, NO_TERM_PARTS
from paragrid.functions.text import trimmed
from paragrid.operators.sequence import running_group
from paragrid.sources.tables import written

#: How far starts of one block may be from each other, how many isolated starts may go, and how far behind a heading definitions begin.
GAP, MOST_TRIMS, AHEAD = 20, 5, 8
QUOTES = {'"': '"”', "“": '”"', "‘": "’'", "«": "»"}
_TERM = "|".join(f"{a}([^{b}]{{1,79}})[{b}]" for a, b in QUOTES.items())
HEADING = r"(?i)^\s*(?:(?:Article|Clause|Section|Art\.|Cl\.|Sec\.)\s*\d+\s*[.:–—-]?\s*|\d+\s*[.:–—-]?\s+)?(?:Definitions(?:\s+and\s+Interpretation)?|Defined\s+Terms|Interpretation)\s*\.?\s*$"
PREDICATE = r"(?U)^\s*[“”\"«»‘’']?\s*[A-Z][\w/&’'-]*(?:\s+[A-Z\d][\w/&’'-]*)*\s*[”\"»]?\s*(?:\s*[:–—-]\s*|\s+)(?i:means|shall\s+mean|has\s+the\s+meaning|indicates|signifies|refers\s+to)\b"


def quoted_term(text: Column) -> Column:
    """The term in quotes that a text begins with, closed within 80 characters; else null."""
    found = F.regexp_extract(text, rf"(?U)^\s*(?:{_TERM})", 0)
    term = trimmed(F.substring(trimmed(found), F.lit(2), F.length(trimmed(found)) - 2))
    return F.when((found != "") & (term != ""), term)


def bold_term(runs: Column, text: Column) -> Column:
    """The bold words that a text with a colon begins with, up to a run that begins with a colon; null for other texts and for words of letters and notices."""
    kind = "struct<parts:array<string>,on:boolean,off:boolean>"
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("on"), F.lit(False).alias("off")).cast(kind)

    def step(s: Column, r: Column) -> Column:
        piece = trimmed(F.coalesce(r["text"], F.lit("")))
        more = F.coalesce(r["bold"], F.lit(False)) & (piece != "")
        colon = piece.startswith(":")
        made = F.struct(F.when(more, F.array_append(s["parts"], piece)).otherwise(s["parts"]).alias("parts"), more.alias("on"), (~more & ~colon).alias("off"))
        return F.when(s["on"], made).otherwise(s)

    read = F.aggregate(runs, start, step)
    term = trimmed(F.regexp_replace(F.array_join(read["parts"], " "), ":+$", ""))
    head = F.lower(F.regexp_replace(trimmed(F.regexp_extract(term, "(?s)^([^:]*)", 1)), "[,. ]+$", ""))
    stopped = head.isin(BOLD_NO_TERMS) | reduce(lambda c, x: c | head.startswith(x), BOLD_NO_TERM_STARTS, F.lit(False))
    return F.when((F.size(read["parts"]) > 0) & ~read["off"] & text.contains(":") & ~stopped, term)


def is_real_term(term: Column) -> Column:
    """Whether a term can be one: of 60 characters or fewer, without quotes, definition verbs or a colon at its end."""
    t = trimmed(F.coalesce(term, F.lit("")))
    return (t != "") & (F.length(t) <= 60) & ~reduce(lambda c, x: c | t.contains(x), NO_TERM_PARTS, F.lit(False)) & ~t.endswith(":")


def is_start(text: Column, runs: Column | None = None) -> Column:
    """A quoted term with five characters or more behind it, or a bold term before a colon."""
    rest = F.regexp_replace(text, rf"(?U)^\s*(?:{_TERM})", "")
    quoted = F.coalesce(quoted_term(text).isNotNull() & (F.length(trimmed(rest)) >= 5), F.lit(False))
    return quoted if runs is None else quoted | bold_term(runs, text).isNotNull()


def is_heading(style: Column | None, outline: Column | None = None) -> Column:
    named = F.lit(False) if style is None else reduce(lambda c, x: c | F.coalesce(F.lower(style).startswith(x), F.lit(False)), HEADING_STYLES, F.lit(False))
    return named if outline is None else named | outline.isNotNull()


def _capitals(text: Column) -> Column:
    t = trimmed(text)
    return (t == F.upper(t)) & (F.length(t) > 5) & ~F.substring(t, 1, 3).rlike(r"\d")


def sections(rows: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx", style: str | None = None, runs: str | None = None) -> DataFrame:
    """doc, first, last, n, by: the block of each document that has one, with the number of definition starts in it.

    by cluster: two or more starts, after up to five isolated ones are dropped from the front, of which the first three stand within three gaps (two: within
    one). The block reaches from the first of them to the last row before the next heading or line in capitals, or to the document's end.
    by heading: a heading that names definitions with three or more predicates (term, then means or the like) in the eight rows behind it; up
    to the last predicate that follows within a gap."""
    whole = Window.partitionBy(doc)
    at = whole.orderBy("pos")
    words = F.coalesce(text, F.lit(""))
    heading = is_heading(F.col(style)) if style else F.lit(False)
    blank, start, hit, large = trimmed(words) == "", is_start(words, F.col(runs) if runs else None), words.rlike(PREDICATE), _capitals(words)
    capitals = large & ~trimmed(words).rlike('^["“‘«]') & ~F.substring(trimmed(words), 1, 30).contains(":")
    title = (F.length(trimmed(words)) <= 80) & words.rlike(HEADING)
    flags = rows.select(doc, F.col(order).alias("o"), start.alias("start"), hit.alias("hit"), title.alias("title"), (~blank & ~start & (heading | capitals)).alias("stop"), (heading | large).alias("large"), blank.alias("blank"))
    told = written(flags.withColumn("pos", F.row_number().over(whole.orderBy("o"))), "flags")  # texts are read once, and gaps are counted in rows

    starts = told.where("start").select(doc, "pos")
    for k in (1, 2, 3):
        starts = starts.withColumn(f"s{k}", F.lead("pos", k).over(at))
    here, rank = F.col("pos"), F.row_number().over(at)
    tail = F.when(F.col("s3").isNotNull(), F.col("s3") - F.col("s1") <= 3 * GAP).otherwise(F.col("s2").isNotNull() & (F.col("s2") - F.col("s1") <= GAP))
    isolated = F.coalesce((F.col("s1") - here > GAP) & tail, F.lit(False))
    ranked = starts.withColumn("rank", rank).withColumn("stays", ~isolated | (rank > MOST_TRIMS))
    first = F.min(F.when(F.col("stays"), F.col("rank"))).over(whole)
    kept = ranked.withColumn("from", first).where(F.col("rank") >= F.col("from"))
    tight = F.when(F.col("s2").isNotNull(), F.col("s2") - here <= 3 * GAP).otherwise(F.coalesce(F.col("s1") - here <= GAP, F.lit(False)))
    broken = F.sum(F.when(here - F.lag("pos").over(at) > GAP, 1).otherwise(0)).over(at)
    kept = kept.withColumns({"tight": F.first(tight).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "broken": broken}).where("tight and broken = 0")
    clusters = kept.groupBy(doc).agg(F.min("pos").alias("first"), F.max("pos").alias("final"))
    inside = told.join(clusters, doc).where(F.col("pos") >= F.col("first"))
    ended = F.max(F.col("stop") & (F.col("pos") > F.col("final"))).over(at)
    by_cluster = inside.withColumn("ended", ended).where("not ended").groupBy(doc).agg(F.min("o").alias("first"), F.max("o").alias("last"), F.sum(F.col("start").cast("int")).cast("long").alias("n"), F.lit("cluster").alias("by"))
    by_cluster = written(by_cluster, "clusters")

    rest = told.join(by_cluster.select(doc), doc, "left_anti")
    ahead = at.rowsBetween(1, AHEAD)
    hits = F.coalesce(F.sum(F.col("hit").cast("int")).over(ahead), F.lit(0))
    near = rest.withColumns({"hits": hits, "head": F.min(F.when(F.col("hit"), F.col("pos"))).over(ahead), "tail": F.max(F.when(F.col("hit"), F.col("pos"))).over(ahead)})
    heads = near.where(F.col("title") & (F.col("hits") >= 3)).groupBy(doc).agg(F.min(F.struct("pos", "head", "tail")).alias("at")).select(doc, F.col("at.head").alias("first"), F.col("at.tail").alias("tail"))
    behind = rest.join(heads, doc).where(F.col("pos") >= F.col("first"))
    followed = behind.where(F.col("pos") >= F.col("tail")).withColumn("far", F.col("pos") - F.max(F.when(F.col("hit"), F.col("pos"))).over(at.rowsBetween(Window.unboundedPreceding, -1)) > GAP)
    ends = ~F.col("blank") & (F.coalesce(F.col("far"), F.lit(False)) | (~F.col("hit") & F.col("large")))
    reached = followed.withColumn("ended", F.max(ends).over(at)).where(F.col("hit") & ~F.col("ended"))
    last = reached.groupBy(doc).agg(F.max("pos").alias("last"))
    by_heading = behind.join(last, doc).where(F.col("pos") <= F.col("last")).groupBy(doc).agg(F.min("o").alias("first"), F.max("o").alias("last"), F.sum(F.col("hit").cast("int")).cast("long").alias("n"), F.lit("heading").alias("by"))
    return by_cluster.unionByName(by_heading)


def grouped(rows: DataFrame, found: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx", runs: str | None = None) -> DataFrame:
    """The rows of each block with group (rows follow their definition's start) and the group's term."""
    inside = rows.join(found.select(doc, "first", "last"), doc).where(F.col(order).between(F.col("first"), F.col("last")))
    words = F.coalesce(text, F.lit(""))
    bold = bold_term(F.col(runs), words) if runs else F.lit(None).cast("string")
    starts = (trimmed(words) != "") & (bold.isNotNull() | trimmed(words).rlike('^["“‘«]'))
    numbered = running_group(inside.withColumns({"term": F.when(starts, F.coalesce(bold, quoted_term(words), F.substring(trimmed(words), 1, 50)))}), F.col("term").isNotNull(), doc, order)
    return numbered.withColumn("term", F.first("term", ignorenulls=True).over(Window.partitionBy(doc, "group"))).where("group > 0")


def reordered(rows: DataFrame, found: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx", runs: str | None = None) -> DataFrame:
    """doc, idx, new_idx of all rows: definitions by lower-cased term (the earlier of equals first), their further rows behind
    them, in the places that the block had. Rows outside stay, as do all rows of a document with a term that can't be one."""
    block = grouped(rows, found, text, doc, order, runs)
    whole = Window.partitionBy(doc)
    real = F.min(is_real_term(F.col("term"))).over(whole)
    placed = block.select(doc, order, "group", "term").withColumns({"head": F.min(order).over(Window.partitionBy(doc, "group")), "real": real, "place": F.row_number().over(whole.orderBy(order))}).where("real")
    to = F.row_number().over(whole.orderBy(F.lower("term"), "head", order))
    moved = written(placed.withColumn("to", to).select(doc, order, "place", "to"), "moved")
    places = moved.select(F.col(doc), F.col("place").alias("to"), F.col(order).alias("new_idx"))
    return rows.select(doc, order).join(moved.select(doc, order, "to").join(places, [doc, "to"]).drop("to"), [doc, order], "left").select(doc, order, F.coalesce("new_idx", order).alias("new_idx"))


def out_of_order(rows: DataFrame, term: str = "term", least: int = 3, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc, block, place, term, expected: consecutive rows with terms, three or more, that aren't in lower-case order."""
    at = Window.partitionBy(doc).orderBy(order)
    numbered = rows.withColumn("block", F.sum(F.when(F.col(term).isNull(), 1).otherwise(0)).over(at)).where(F.col(term).isNotNull())
    terms = numbered.groupBy(doc, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.lower(term).alias("t")))), lambda x: x["t"]).alias("terms")).where(F.size("terms") >= least)
    zipped = F.zip_with("terms", F.array_sort("terms"), lambda a, b: F.struct(a.alias("term"), b.alias("expected")))
    return terms.select(doc, "block", F.posexplode(zipped).alias("place", "pair")).select(doc, "block", "place", "pair.*").where("term <> expected")
