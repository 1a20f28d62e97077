"""Auxiliary parts: numbering formats, comments, headers and footers with fields, text over several pieces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of level formats by language, in the order of the English ones below.
NUMBERING_ENGLISH = ["Schedule", "Appendix", "Chapter", "Article", "Section", "Part"]
NUMBERING_WORDS = {
    "italian": ["allegato", "appendice", "capitolo", "articolo", "sezione", "parte"],
    "german": ["anlage", "anhang", "kapitel", "artikel", "abschnitt", "teil"],
    "french": ["annexe", "appendice", "chapitre", "article", "section", "partie"],
    "spanish": ["anexo", "apéndice", "capítulo", "artículo", "sección", "parte"],
    "portuguese": ["anexo", "apêndice", "capítulo", "artigo", "secção", "parte"],
    "dutch": ["bijlage", "aanhangsel", "hoofdstuk", "artikel", "afdeling", "deel"],
    "polish": ["załącznik", "dodatek", "rozdział", "artykuł", "sekcja", "część"],
    "finnish": ["liite", "lisäys", "luku", "artikla", "jakso", "osa"],
}
# The rules of the language whose formats aren't regular (pattern, replacement), the first that fits counts.
HUNGARIAN_NUMBERING = [
    (r"%(\d+)\.\s*sz\.\s*melléklet", "Schedule %$1"),
    (r"%(\d+)\.\s*melléklet", "Schedule %$1"),
    (r"melléklet\s*%(\d+)", "Schedule %$1"),
    (r"%(\d+)\.\s*sz\.\s*függelék", "Appendix %$1"),
    (r"%(\d+)\.\s*függelék", "Appendix %$1"),
    (r"%(\d+)\.\s*fejezet", "Chapter %$1"),
    (r"%(\d+)\.\s*rész", "Part %$1"),
    (r"%(\d+)\.\s*cikk", "Clause %$1"),
    (r"%(\d+)\.\s*szakasz", "Section %$1"),
    (r"%(\d+)\.\s*sz\.", "%$1."),
]
ARTIFACT_AUTHORS = ["", "Unknown", "LibreOffice", "OpenOffice", "Microsoft Office", "Office"]


def numbering_rules(language: str) -> list[tuple[str, str]]:
    if language == "hungarian":
        return HUNGARIAN_NUMBERING
    words = NUMBERING_WORDS[language]
    rules = [(rf"%(\d+)\.\s*{w}", f"{e} %$1") for w, e in zip(words, NUMBERING_ENGLISH)]
    return [rules[0], (rf"{words[0]}\s*%(\d+)", "Schedule %$1"), *rules[1:]]


def translate_level(level: Column, language: str, custom: list[tuple[str, str]] | None = None) -> Column:
    """A level format in English: the first rule that fits is applied, others aren't tried."""
    rules = custom if custom is not None else numbering_rules(language)
    return reduce(lambda rest, r: F.when(F.regexp_like(level, F.lit(f"(?iU){r[0]}")), F.regexp_replace(level, f"(?iU){r[0]}", r[1])).otherwise(rest), reversed(rules), level)


def numbering_language(levels: DataFrame, doc: str = "doc_id", level: str = "level") -> DataFrame:
    """doc, language: the language most of whose words stand in a document's level formats, null if none does."""
    scores = [F.struct(sum((F.lower(level).contains(w).cast("int") for w in ws[1:]), F.lower(level).contains(ws[0]).cast("int")).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(NUMBERING_WORDS.items())]
    each = levels.select(doc, F.inline(F.array(*scores))).groupBy(doc, "k", "lang").agg(F.sum("n").alias("n"))
    best = each.groupBy(doc).agg(F.max(F.struct("n", "k", "lang")).alias("b"))
    return best.select(doc, F.when(F.col("b.n") > 0, F.col("b.lang")).alias("language"))


def translate_comments(comments: DataFrame, translations: DataFrame) -> DataFrame:
    """comments (path, id, text) with en and status: translated, kept (no, blank or equal text)."""
    en = F.col("t.en")
    kept = en.isNull() | (F.trim(en) == "") | (en == F.col("c.text"))
    return comments.alias("c").join(translations.alias("t"), (F.col("c.path") == F.col("t.path")) & (F.col("c.id") == F.col("t.id")), "left").select("c.*", F.when(kept, F.col("c.text")).otherwise(en).alias("en"), F.when(kept, "kept").otherwise("translated").alias("status"))


def replace_terms(text: Column, terms: list[tuple[str, str]]) -> Column:
    """Literal replacements, the longest term first."""
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), sorted(terms, key=lambda r: -len(r[0])), text)


def field_text(rows: DataFrame, mark: str, kind: str, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc, text, fields: the visible text with <<KIND>> in place of each field's result, and the fields in order."""
    from paragrid.operators.sequence import field_regions

    shown = F.when(F.col(mark) == "begin", F.concat(F.lit("<<"), F.coalesce(kind, F.lit("FIELD")), F.lit(">>"))).when((F.col("region") == "outside") & F.col(mark).isNull(), F.coalesce(text, F.lit(""))).otherwise("")
    made = field_regions(rows, mark, doc, order).withColumn("shown", shown)
    in_order = lambda column: F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), column.alias("x"))))
    fields = F.array_sort(F.collect_list(F.when(F.col(mark) == "begin", F.struct(F.col(order).alias("o"), F.col(kind).alias("x")))))
    return made.groupBy(doc).agg(F.array_join(F.transform(in_order(F.col("shown")), lambda s: s["x"]), "").alias("text"), F.transform(fields, lambda s: s["x"]).alias("fields"))


def field_zones(en: Column, fields: Column) -> Column:
    """The parts of a translation between its field marks: one more than the fields, padded with empty ones or merged at the end."""
    parts = F.split(en, "<<[A-Z]+>>")
    n = F.size(fields) + 1
    padded = F.concat(parts, F.transform(F.sequence(F.lit(0), n), lambda _: F.lit("")))
    return F.concat(F.slice(padded, 1, n - 1), F.array(F.array_join(F.slice(parts, n, F.greatest(F.size(parts) - n + 1, F.lit(1))), "")))


def cut_places(sizes: list[int], text: str, window: int = 20) -> list[int]:
    """Where a text is cut to lie over pieces in proportion to their sizes; cuts move to behind the nearest blank within the window."""
    total, done, places = sum(sizes), 0, [0]
    if len(sizes) <= 1:
        return [0, len(text)]
    blanks = [k + 1 for k, c in enumerate(text) if c == " "]
    for size in sizes[:-1]:
        done += size
        ideal = round(done / total * len(text)) if total else len(text)
        near = [b for b in blanks if abs(b - ideal) <= window]
        if 0 < ideal < len(text) and near:
            ideal = min(near, key=lambda b: (abs(b - ideal), b))
        places.append(max(places[-1], ideal))
    return [*places, len(text)]


def over_pieces(old: list[str], new: str | None) -> list[str]:
    """A text laid over pieces in proportion to what they held; blanks at the very ends stay, a missing or empty text leaves all."""
    if not old or not new:
        return old
    at = cut_places([len(x) for x in old], new)
    made = [new[a:b] for a, b in zip(at, at[1:])]
    first, last = old[0][: len(old[0]) - len(old[0].lstrip(" \t"))], old[-1][len(old[-1].rstrip(" \t")) :]
    made[0] = made[0] if made[0][:1] in (" ", "\t") else first + made[0]
    made[-1] = made[-1] if made[-1][-1:] in (" ", "\t") else made[-1] + last
    return made


def distribute(rows: DataFrame, pieces: str = "pieces", text: str = "en") -> DataFrame:
    """rows with parts: the text over the pieces; a missing text leaves them, blanks at the ends of the pieces stay."""
    columns = [c for c in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [over_pieces([x or "" for x in ([] if old is None else old)], new) for old, new in zip(batch[pieces], batch[text])]
            yield batch.assign(parts=parts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.select(*columns).mapInPandas(run, f"{schema}, parts array<string>")


def edited_by_people(counts: DataFrame) -> DataFrame:
    """counts (n_ins, n_del, authors) with edited: an author who is no converter, or ten revisions of which most are of one kind."""
    human = F.exists("authors", lambda a: ~a.isin(ARTIFACT_AUTHORS))
    lopsided = (F.col("n_ins") + F.col("n_del") >= 10) & (F.greatest("n_ins", "n_del") >= 5 * F.greatest(F.least("n_ins", "n_del"), F.lit(1)))
    return counts.withColumn("edited", human | lopsided)
