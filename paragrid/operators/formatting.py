"""Formatting of runs, page breaks, bold ranges, and the records that translators fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrid.functions.rules import DEFINITION_VERBS

# Terms that stay italic.
LATIN_TERMS = ["inter alia", "mutatis mutandis", "pari passu", "pro rata", "bona fide", "vis-à-vis", "de facto", "de jure", "prima facie", "sui generis", "et seq.", "ad hoc", "ab initio", "ultra vires", "per se", "in rem"]


def _loses_italic(run: Column) -> Column:
    t = F.trim(F.coalesce(run["text"], F.lit("")))
    latin = F.exists(F.array(*map(F.lit, LATIN_TERMS)), lambda w: F.contains(F.lower(t), w))
    return run["italic"] & (F.size(F.split(t, r"\s+")) > 2) & ~t.rlike(r"^\(.*\)$") & ~latin


def clear_italics(rows: DataFrame, runs: str = "runs", heading: Column | None = None, paragraph_italic: str = "p_italic") -> DataFrame:
    """rows whose longer italic runs are upright, and cleared, how many; headings and italic paragraphs stay."""
    stays = F.coalesce(F.col(paragraph_italic), F.lit(False)) | (F.lit(False) if heading is None else heading)
    hits = F.size(F.filter(runs, _loses_italic))
    upright = F.transform(runs, lambda r: F.when(_loses_italic(r), r.withField("italic", F.lit(False))).otherwise(r))
    return rows.withColumns({"cleared": F.when(stays | F.col(runs).isNull(), 0).otherwise(hits), runs: F.when(stays, F.col(runs)).otherwise(upright)})


def wants_page_break(text: Column, style: Column, exempt: list[str] | None = None) -> Column:
    """Headings of schedules begin a page, but for lists of contents."""
    return F.trim(text).rlike(r"(?i)^(?:schedule|appendix)\s+(?:\d+|[A-Z])\b.{0,60}$") & ~F.lower(F.coalesce(style, F.lit(""))).rlike("|".join(exempt or ["toc", "header", "footer"]))


def bold_ranges(text: Column) -> Column:
    """(start, end) of quoted terms before a definition verb."""
    verbs = "|".join(DEFINITION_VERBS)
    terms = F.regexp_extract_all(text, F.lit(rf"([“\"«][^”\"»]{{1,80}}[”\"»])\s+(?:{verbs})\b"), 1)
    return F.transform(terms, lambda t: F.struct((F.position(t, text) - 1).alias("start"), (F.position(t, text) - 1 + F.length(t)).alias("end")))


def is_subheader(text: Column, runs: Column) -> Column:
    """At most ten words, and all runs that aren't blank are bold."""
    inked = F.filter(runs, lambda r: F.trim(r["text"]) != "")
    return (F.size(F.split(F.trim(text), r"\s+")) <= 10) & (F.size(inked) > 0) & F.forall(inked, lambda r: r["bold"])


def skeleton(segments: Column, mark: str = "<TRANSLATE>") -> Column:
    """As many target segments as the source has: the first insertion and the first deletion carry a mark, other revisions are
    cleared, and regular ones keep their text (null)."""
    before = lambda i, kind: F.exists(F.slice(segments, F.lit(1), i), lambda s: s["type"] == kind)

    def one(s: Column, i: Column) -> Column:
        first = s["type"].isin("ins", "del") & ~before(i, s["type"])
        return F.struct(s["type"].alias("type"), F.when(s["type"] == "regular", F.lit(None)).when(first, F.lit(mark)).otherwise("").alias("en"))

    return F.transform(segments, one)


def split_with_zero_width(text: Column) -> Column:
    """A zero-width blank between the second and third letter of words of four letters or more."""
    return F.regexp_replace(text, r"(?U)\b(\p{L}{2})(?=\p{L}{2})", "$1​")


def target_entries(records: DataFrame, doc: str = "doc", order: str = "idx") -> DataFrame:
    """doc, idx, field, text: translations, deleted translations and translated segments of paragraph records, empty ones left out."""
    one = lambda name, column: F.struct(F.lit(name).alias("field"), column.alias("text"))
    segments = F.coalesce(F.transform("en_segments", lambda s, i: F.struct(F.concat(F.lit("en_segments["), i.cast("string"), F.lit("]")).alias("field"), s["en"].alias("text"))), F.array().cast("array<struct<field:string,text:string>>"))
    fields = F.concat(F.array(one("en", F.col("en")), one("en_deleted", F.col("en_deleted"))), segments)
    return records.select(doc, order, F.inline(F.filter(fields, lambda f: F.trim(F.coalesce(f["text"], F.lit(""))) != "")))


def scaffold(paragraphs: DataFrame) -> DataFrame:
    """path, idx, source, p_idx, text: header and footer paragraphs that aren't empty, numbered over a package and within each part."""
    rows = paragraphs.where(F.col("part").rlike("word/(?:header|footer)") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    numbered = rows.withColumns({"n": F.row_number().over(Window.partitionBy("path").orderBy("part", "idx")) - 1, "p_idx": F.row_number().over(Window.partitionBy("path", "part").orderBy("idx")) - 1})
    return numbered.select("path", F.col("n").alias("idx"), F.col("part").alias("source"), "p_idx", "text")


def variant_pairs(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """uk, us: word pairs from glossary rows of two cells whose alternatives stand in the same order."""
    sides = F.arrays_zip(F.split(F.col(cells)[0], r"\s*/\s*").alias("uk"), F.split(F.col(cells)[1], r"\s*/\s*").alias("us"))
    return rows.where(F.size(cells) >= 2).select(F.inline(sides)).where("uk is not null and us is not null and uk <> us").distinct()
