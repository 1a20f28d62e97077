"""Source-language detection and words left in the source language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.functions.rules import ALLOWED_CONTEXTS, DETECTION_WORDS, REMNANT_MARKERS, SUBSTRING_LANGUAGES


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}\p{Pc}]+")


def score(text: Column, words: Column, language: str, found: list[str]) -> Column:
    """How often the words of a language stand in a text; words: the text's words that any language has. Phrases and
    languages without blanks are looked for in the text itself."""
    if language in SUBSTRING_LANGUAGES:
        return sum((F.regexp_count(text, F.lit(w)) for w in found[1:]), F.regexp_count(text, F.lit(found[0])))
    single = [w.lower() for w in found if " " not in w]
    n = F.size(F.filter(words, lambda w: w.isin(single)))
    for phrase in (w for w in found if " " in w):
        hit = F.lower(text).contains(phrase.split(" ")[0])
        n = n + F.when(hit, F.regexp_count(text, F.lit(r"(?iU)\b" + phrase.replace(" ", r"\s+") + r"\b"))).otherwise(0)
    return n


def detect(text: Column, least: int = 5, default: str | None = None, table=None) -> Column:
    """The language with most hits (the first in the table of equals), if there are enough.

    The text is split once; the words that no language has go before the languages are counted."""
    table = table or DETECTION_WORDS
    known = sorted({w.lower() for lang, found in table if lang not in SUBSTRING_LANGUAGES for w in found if " " not in w})
    few = F.array(F.filter(_words(text), lambda w: w.isin(known)))

    def best(words: Column) -> Column:
        scores = [F.struct(score(text, words, lang, found).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, found) in enumerate(table)]
        return F.greatest(*scores)

    top = F.transform(few, best)[0]
    return F.transform(F.array(top), lambda t: F.when(t["n"] >= least, t["lang"]).otherwise(F.lit(default)))[0]


def remnants(entries: DataFrame, language: Column, text: str = "text", allowed: list[str] = ALLOWED_CONTEXTS, markers=REMNANT_MARKERS) -> DataFrame:
    """entries with lang, marker and n for each marker of the row's language in it; rows of languages without markers give
    one row with a null marker: not checked, which isn't clean. Hits within allowed contexts don't count."""
    clean = F.col(text)
    for phrase in allowed:
        clean = F.replace(clean, F.lit(phrase), F.lit("\u0001"))
    known = [lang for lang, _ in markers]
    made = entries.withColumns({"lang": language, "__clean": clean})
    hits = F.lit(None).cast("array<struct<marker:string,n:int>>")
    for lang, found in markers:
        each = F.array(*[F.struct(F.lit(m).alias("marker"), F.regexp_count("__clean", F.lit(m if lang in SUBSTRING_LANGUAGES else rf"(?iU)\b{m}\b")).alias("n")) for m in found])
        hits = F.when(F.col("lang") == lang, F.filter(each, lambda h: h["n"] > 0)).otherwise(hits)
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("marker"), F.lit(0).alias("n")))
    found = made.withColumn("__hits", F.when(F.col("lang").isin(known), hits).otherwise(unknown)).select(*entries.columns, "lang", F.inline_outer("__hits"))
    return found.where("n is not null")


# Letters that hint at a language where no phrase does.
LETTERS = {"finnish": "äöå", "hungarian": "őűáéíóú", "polish": "ąćęłńóśźż", "portuguese": "ãõçâêôáéíóú", "spanish": "ñ¿¡áéíóú", "german": "äöüß", "french": "çœ"}


def guess(text: Column, least: int = 5) -> Column:
    """The policy for phrase rules: Japanese and Chinese by script, then the detected language, then the language with most
    letters of its own, else ``*``, which lets all rules apply."""
    letters = F.greatest(*[F.struct(F.regexp_count(F.lower(text), F.lit(f"[{c}]")).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, c) in enumerate(LETTERS.items())])
    by_letters = F.when(letters["n"] >= least, letters["lang"]).otherwise("*")
    return F.when(text.rlike("[\\u3040-\\u30ff]"), "japanese").when(text.rlike("[\\u4e00-\\u9fff]"), "chinese").otherwise(F.coalesce(detect(text, least), by_letters))
