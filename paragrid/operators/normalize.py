"""Ordered normalisation passes over texts and over neighbouring pieces, with the number of changes of each pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrid.functions.rules import ANNEX_EXCLUDE, DEFINITION_VERBS, INTERNAL_ANCHORS, INTERNAL_DETERMINERS, INTERNAL_LOCATORS, SPELLINGS, TERM_LITERALS, TERM_REPLACEMENTS, TO_US_ONLY, WIDE_SPELLINGS
from paragrid.functions.text import any_of, begun, needs_space, replace_all, sooner

Pass = tuple[str, Callable[[Column], Column]]


def double_punctuation(t: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "::", ":"), r"(?<!\.)\.\.(?!\.)", "."), ",,", ","), ";;", ";")
    return F.when(t.rlike(r"([:.,;])\1"), made).otherwise(t)


def definition_boundaries(t: Column) -> Column:
    return F.regexp_replace(t, r"([A-Z”\"»)])(" + "|".join(DEFINITION_VERBS) + r")\b", "$1 $2")


def terminology(t: Column) -> Column:
    """Literal replacements, then those by pattern. Texts that hold none of the literals, as most do, are looked through once."""
    literal = F.when(F.regexp_like(t, F.lit(any_of([a for a, _ in TERM_LITERALS]))), reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), TERM_LITERALS, t)).otherwise(t)
    return F.transform(F.array(literal), lambda x: replace_all(x, [(sooner(a), b) for a, b in TERM_REPLACEMENTS]))[0]


def spelling(to: str, wide: bool = False) -> Callable[[Column], Column]:
    """Spellings of one side as those of the other; the wide tables hold more, and some words that only become US ones."""
    both = SPELLINGS + (WIDE_SPELLINGS if wide else [])
    pairs = both if to == "uk" else [(b, a) for a, b in both] + (TO_US_ONLY if wide else [])
    held = begun(sorted({a[0] for a, _ in pairs}), r"(?U)\b(?:" + any_of([a for a, _ in pairs]) + r")\b")
    return lambda t: F.when(F.regexp_like(t, F.lit(held)), replace_all(t, [(rf"(?U)\b{a}\b", b) for a, b in pairs])).otherwise(t)


def annexes(t: Column) -> Column:
    return F.when(~t.rlike("A(?:nnex|NNEX)") | t.rlike("|".join(ANNEX_EXCLUDE)), t).otherwise(replace_all(t, [(r"\bAnnexes\b", "Schedules"), (r"\bAnnex\b", "Schedule"), (r"\bANNEX\b", "SCHEDULE")]))


def doubled_words(t: Column) -> Column:
    return F.regexp_replace(t, r"(?iU)\b(\w{3,}+)\s++\1\b", "$1")  # possessive: a word's end and a blank's can't be elsewhere


def definition_line_breaks(t: Column) -> Column:
    """A definition, which has a verb of definitions and a quote, stands on one line."""
    return F.when(t.rlike("|".join(DEFINITION_VERBS)) & t.rlike("[“\"„]"), F.regexp_replace(t, r"\s*\n\s*", " ")).otherwise(t)


_CITED = r"Articles?\s+\d[\d.:]*(?:-[A-Za-z]{1,15})*"
#: How far behind a citation its target is looked for, and how much of what was read tells determiners.
_REACH, _BEHIND = 250, 24


def _is_outside(tail: Column) -> Column:
    """Whether what follows a citation names an act of its own, told by the first word that decides.

    The rest of the sentence is read word by word: a locator (above, hereof) or a part of the document (Schedule, Clause) means inside, as does
    a capitalized word behind a determiner (this, the said); any other capitalized word means outside. Lower-case words, figures and further
    citations decide nothing; a sentence without a deciding word means inside."""
    sentence = F.regexp_replace(tail, r"(?s)(?:[!?\n]|\.(?= *\p{Lu}|\z)).*\z", "")
    read = F.regexp_extract_all(F.regexp_replace(sentence, rf"(?U)\b{_CITED}", "#"), F.lit(r"(\s*(?:[A-Za-z][A-Za-z0-9'-]*|[^\sA-Za-z]))"), 1)
    start = F.struct(F.lit(None).cast("boolean").alias("outside"), F.lit("").alias("behind"))

    def step(state: Column, token: Column) -> Column:
        word = F.regexp_replace(token, r"^\s+", "")
        behind = F.lower(F.regexp_replace(F.concat(state["behind"], F.regexp_extract(token, r"^\s*", 0)), r"\s+\z", ""))
        determined = behind.rlike("(?:^| )(?:" + "|".join(INTERNAL_DETERMINERS) + r")\z")
        told = F.when(F.lower(word).isin(INTERNAL_LOCATORS), False).when(~word.rlike("^[A-Z]"), F.lit(None).cast("boolean")).otherwise(~word.isin(INTERNAL_ANCHORS) & ~determined)
        kept = F.concat(state["behind"], token)
        return F.when(state["outside"].isNotNull(), state).otherwise(F.struct(told.alias("outside"), F.substring(kept, F.greatest(F.length(kept) - _BEHIND + 1, F.lit(1)), F.lit(_BEHIND)).alias("behind")))

    return F.aggregate(read, start, step, lambda s: F.coalesce(s["outside"], F.lit(False)))


def internal_articles(t: Column, to: str = "Clause", around: Column | None = None, offset: Column | int = 0) -> Column:
    """Article N becomes Clause N, Articles N Clauses N, but for citations of other acts (see ``_is_outside``), one by one.

    Where t is a piece of a longer text, ``around`` is that text and ``offset`` the piece's place in it: what follows is read there."""
    around = t if around is None else around
    chunks = F.split(t, rf"(?U)(?=\b{_CITED})")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, chunk: Column) -> Column:
        rest = F.substring(around, state["at"] + offset + 1, F.lit(_REACH + 100))
        tail = F.substring(rest, F.length(F.regexp_extract(rest, rf"(?U)^{_CITED}", 0)) + 1, F.lit(_REACH))
        inside = chunk.rlike(rf"(?U)^{_CITED}") & ~_is_outside(tail)
        made = F.when(inside, F.regexp_replace(chunk, r"(?U)^Article(s?)\s+(?=\d)", f"{to}$1 ")).otherwise(chunk)
        return F.struct((state["at"] + F.length(chunk)).alias("at"), F.concat(state["out"], F.array(made)).alias("out"))

    rewritten = F.aggregate(chunks, start, step, lambda s: F.array_join(s["out"], ""))
    return F.when(t.contains("Article") & t.rlike(rf"(?U)\b{_CITED}"), rewritten).otherwise(t)


def passes(variant: str = "uk", tree: str = "uk") -> list[Pass]:
    """The passes in order. The us tree has the wide spelling tables, and its us variant calls articles of the document sections."""
    wide = tree == "us"
    articles = (lambda t: internal_articles(t, "Section")) if wide and variant == "us" else internal_articles
    return [
        ("definition_boundaries", definition_boundaries),
        ("double_punctuation", double_punctuation),
        ("terminology", terminology),
        ("spelling", spelling(variant, wide)),
        ("annexes", annexes),
        ("internal_articles", articles),
        ("doubled_words", doubled_words),
        ("definition_line_breaks", definition_line_breaks),
    ]


def _stepped(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["t"].alias("before"), step(s["t"]).alias("t"), s["changed"].alias("changed"))


def _noted(name: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["t"].alias("t"), F.when(s["before"].eqNullSafe(s["t"]), s["changed"]).otherwise(F.array_append(s["changed"], F.lit(name))).alias("changed"))


def apply_passes(rows: DataFrame, steps: list[Pass] | None = None, text: str = "text") -> DataFrame:
    """rows with the text after all passes, and changed, the names of the passes that changed it.

    Each pass works on a lambda's variable, so that the plan grows with the number of passes and not with its power."""
    now = F.array(F.struct(F.col(text).alias("t"), F.array().cast("array<string>").alias("changed")))
    for name, step in passes() if steps is None else steps:
        now = F.transform(F.transform(now, _stepped(step)), _noted(name))
    return rows.withColumn("__passes", now[0]).withColumns({text: F.col("__passes.t"), "changed": F.col("__passes.changed")}).drop("__passes")


def fix_spacing(pieces: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """pieces with a blank put before each one that would run into the one before."""
    before = F.lag(text).over(Window.partitionBy(doc).orderBy(order))
    return pieces.withColumn("__b", before).withColumn(text, F.when(needs_space(F.col("__b"), F.col(text)), F.concat(F.lit(" "), text)).otherwise(F.col(text))).drop("__b")


def drop_doubled_across(pieces: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """pieces without the first word of one that is the last word of the piece before (three letters or more, case and punctuation aside); blank pieces don't count."""
    at = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col(text).rlike(r"(?U)\S"), F.col(text)), ignorenulls=True).over(at)
    ends = F.regexp_replace(F.regexp_extract("__b", r"(?U)(\S+)\s*$", 1), r"[,;:.\"')\]]+$", "")
    begins = F.regexp_replace(F.regexp_extract(text, r"(?U)^\s*(\S+)", 1), r"^[\"'(\[]+", "")
    doubled = F.coalesce((F.lower(ends) == F.lower(begins)) & ends.rlike(r"^\p{L}{3,}$"), F.lit(False))
    return pieces.withColumn("__b", before).withColumn(text, F.when(doubled, F.regexp_replace(text, r"(?U)^\s*\S+\s*", " ")).otherwise(F.col(text))).drop("__b")


def close_quotes(t: Column) -> Column:
    """Closes a quote that is still open before a definition verb."""
    return F.regexp_replace(t, r"“([^”“]{1,80}?)\s+(" + "|".join(DEFINITION_VERBS) + r")\b", "“$1” $2")
