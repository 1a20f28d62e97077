"""Quality checks of translated paragraphs: one pass over the rows gives the findings of all checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrid.functions.rules import DEFINITION_VERBS, FORBIDDEN_TITLES, LAST_WORDS, LEGISLATION_WORDS, PLACEHOLDERS, SPELLINGS, TERM_VIOLATIONS, UNCHECKED_SPELLINGS
from paragrid.functions.text import any_of, begun, folded, match_count, needs_space, sooner
from paragrid.operators.findings import findings

# Latin terms whose italics no check reports.
LATIN_CHECKED = ["inter alia", "mutatis mutandis", "pari passu", "pro rata", "bona fide", "de facto", "de jure", "prima facie"]


def _any_of(text: Column, terms: list[str]) -> Column:
    return sum((text.contains(t).cast("int") for t in terms[1:]), text.contains(terms[0]).cast("int"))


def ends_in_function_word(text: Column) -> Column:
    """A line of five words and 20 characters or more, without blanks to fill in, whose last word is a function word."""
    last = F.regexp_extract(text, r"([A-Za-z]+)\s*$", 1)
    return (F.length(F.trim(text)) >= 20) & (F.size(F.split(F.trim(text), r"\s+")) >= 5) & ~text.contains("__") & last.isin(LAST_WORDS)


def dangling(text: Column) -> Column:
    """A paragraph of five words and 20 characters or more that ends in a function word; lists that go on with ``; and``, and
    paragraphs that begin with a placeholder or a blank line to fill in, end so on purpose."""
    trimmed = F.trim(text)
    placeholder = reduce(lambda c, x: c | trimmed.startswith(x), PLACEHOLDERS, trimmed.startswith("_"))
    ends = text.rlike(sooner(r"(?U)\b(?:" + "|".join(LAST_WORDS) + r")\s*$")) & ~text.rlike(r"(?i)[;,]\s*(?:and|or)\s*$")
    return (F.length(text) >= 20) & ends & (F.size(F.split(trimmed, r"(?U)\s+")) >= 5) & ~placeholder


def checks(text: Column, variant: str = "uk", shortest_doubled: int = 1) -> list[tuple[str, str, Column]]:
    """(check, severity, number of findings) on one paragraph. shortest_doubled: letters of the shortest doubled word reported."""
    pairs = [(us, uk) for us, uk in SPELLINGS if us not in UNCHECKED_SPELLINGS]
    wrong = [us if variant == "uk" else uk for us, uk in pairs]
    some = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    has = lambda pattern: text.rlike(pattern).cast("int")
    doubled = F.filter(some(rf"(?iU)\b(\w{{{shortest_doubled},}}+)\s++\1\b"), lambda w: ~F.lower(w).isin("that", "had", "very"))
    before = F.filter(some(r"(?iU)\b(\w++)\s++existing\s++and\s++future\b"), lambda w: ~F.lower(w).isin("and", "the", "all", "any", "of"))
    opened, closed = match_count(text, "[“„]"), match_count(text, "”")
    unclosed = match_count(text, r"(?U)[“\"]\s*[^\"”“]{2,60}?\s+(?:" + "|".join(DEFINITION_VERBS) + r")\b")
    return [
        ("definition_boundary", "WARN", F.when(_any_of(text, DEFINITION_VERBS) > 0, match_count(text, r"(?U)[A-Z”\")](?:" + "|".join(DEFINITION_VERBS) + r")\b")).otherwise(0)),
        ("double_punctuation", "WARN", _any_of(text, ["::", ",,", ";;"]) + F.when(text.contains(".."), has(r"\.\.(?!\.)")).otherwise(0)),
        ("terminology", "BLOCK", _any_of(text, TERM_VIOLATIONS)),
        ("standalone_financing", "WARN", F.replace(text, F.lit("Project Financing"), F.lit("")).contains("Financing").cast("int")),
        ("doubled_word", "WARN", F.size(doubled)),
        ("quotes", "WARN", F.when(_any_of(text, DEFINITION_VERBS) > 0, ((opened > 0) & (opened != closed)).cast("int") + unclosed).otherwise(0)),
        ("title", "BLOCK", _any_of(text, FORBIDDEN_TITLES)),
        ("word_order", "WARN", F.when(folded(text).contains("existing"), F.size(before)).otherwise(0)),
        ("spelling", "WARN", F.size(F.array_distinct(some(begun(sorted({w[0] for w in wrong}), r"(?U)\b(" + any_of(wrong) + r")\b"))))),
        ("article_reference", "WARN", F.when(~text.contains("Article") | (_any_of(text, LEGISLATION_WORDS) > 0), 0).otherwise(match_count(text, sooner(r"(?U)\bArticles?\s+\d{1,2}(?:\.\d+)*")))),
        ("that_precedes", "WARN", match_count(text, r"(?=[tT])(?iU)\bthat (?:precede[sd]?|follow|follows(?! from))\b")),
        ("truncation", "WARN", dangling(text).cast("int")),
    ]


def boundary_findings(pieces: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc, order, check: pieces that run into the one before (``spacing``), or begin with the word that it ends with
    (``doubled_across``). Empty pieces don't count; for doubled words neither do blank ones."""
    at = Window.partitionBy(doc).orderBy(order)
    inked = F.when(F.trim(text) != "", F.col(text))
    near = rows_with_text(pieces, text).withColumns({"__b": F.lag(text).over(at), "__w": F.last(inked, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))})
    ends = F.regexp_replace(F.regexp_extract("__w", r"(?U)(\S+)\s*$", 1), r"[,;:.\"')\]]+$", "")
    begins = F.regexp_replace(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1), r"^[\"'(\[]+", "")
    doubled = (F.lower(ends) == F.lower(begins)) & (F.length(ends) > 2) & ends.rlike(r"^\p{L}+$")
    faults = {"spacing": needs_space(F.col("__b"), F.col(text)), "doubled_across": doubled}
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in faults.items()])
    return near.select(doc, order, F.inline_outer(F.filter(each, lambda x: x["hit"]))).where("check is not null").drop("hit")


def rows_with_text(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.where(F.length(text) > 0)


def truncated_pairs(pairs: DataFrame, source: str = "text", target: str = "en") -> DataFrame:
    """pairs with fault, for sources of 20 characters or more: ``empty`` where more than 30 have no translation, ``short`` where more
    than 50 have one of less than 0.4 of their length."""
    told, made = F.col(source), F.coalesce(F.col(target), F.lit(""))
    n = F.length(told)
    empty = F.trim(made) == ""
    fault = F.when(empty, F.when(F.length(F.trim(told)) > 30, "empty")).when((n > 50) & (F.length(made) / n < 0.4), "short")
    return pairs.withColumn("fault", F.when((F.trim(told) != "") & (n >= 20), fault)).where("fault is not null")


def check_paragraphs(rows: DataFrame, text: str = "text", variant: str = "uk", keys: tuple[str, ...] = ("doc_id", "idx"), shortest_doubled: int = 1, only: list[str] | None = None) -> DataFrame:
    """Findings of all checks, or of those in ``only``; the others are not computed then."""
    return findings(rows, [c for c in checks(F.col(text), variant, shortest_doubled) if only is None or c[0] in only], list(keys))


def length_ratio(pairs: DataFrame, source: str = "text", target: str = "en") -> DataFrame:
    """pairs with ratio and band: missing, block below 0.3 and warn below 0.6 for sources of 150 characters or more, else ok."""
    n, m = F.length(F.coalesce(source, F.lit(""))), F.length(F.trim(F.coalesce(target, F.lit(""))))
    ratio = F.when(n > 0, m / n)
    band = F.when(m == 0, F.when(n > 0, "missing").otherwise("ok")).when((n >= 150) & (ratio < 0.3), "block").when((n >= 150) & (ratio < 0.6), "warn").otherwise("ok")
    return pairs.withColumns({"ratio": F.round(ratio, 4), "band": band})


def lost_quotes(pairs: DataFrame, source: str = "text", target: str = "en") -> DataFrame:
    """pairs with lost: quoted phrases of the source that the target doesn't hold."""
    from paragrid.functions.text import quoted_phrases

    lost = F.filter(quoted_phrases(F.col(source)), lambda q: ~F.coalesce(F.col(target), F.lit("")).contains(q))
    return pairs.withColumn("lost", lost).where(F.size("lost") > 0)


def formatting(rows: DataFrame) -> DataFrame:
    """path, idx, fault of paragraph records: a definition without a bold term or with a line break; italic runs of more than two
    words that are neither in parentheses nor Latin, outside of headings in capitals and italic paragraphs."""
    text, words_of = F.col("text"), lambda t: F.size(F.split(F.trim(t), r"(?U)\s+"))
    quoted = text.contains("“") | text.contains('"')
    definition = quoted & (_any_of(text, [v for v in DEFINITION_VERBS if v != "indicates"]) > 0)
    bold_term = F.exists("runs", lambda r: r["bold"] & (F.length(F.trim(r["text"])) > 2))
    heading = (F.trim(text) == F.upper(F.trim(text))) & (words_of(text) < 10)
    latin = lambda t: reduce(lambda c, w: c | F.contains(F.lower(t), F.lit(w)), LATIN_CHECKED, F.lit(False))
    long_italic = F.exists("runs", lambda r: r["italic"] & (words_of(r["text"]) > 2) & ~F.trim(r["text"]).rlike(r"(?s)^\(.*\)$") & ~latin(r["text"]))
    faults = {
        "definition_not_bold": definition & ~bold_term,
        "definition_line_break": quoted & (_any_of(text, DEFINITION_VERBS) > 0) & text.contains("\n"),
        "italic_run": long_italic & ~heading & ~F.coalesce("p_italic", F.lit(False)),
    }
    each = F.array(*[F.struct(F.lit(n).alias("fault"), F.coalesce(c, F.lit(False)).alias("hit")) for n, c in faults.items()])
    return rows.select("path", "idx", F.inline_outer(F.filter(each, lambda x: x["hit"]))).where("fault is not null").drop("hit")
