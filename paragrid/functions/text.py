"""Scalar text functions as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paragrid.functions.rules import ABBREVIATIONS, DEFINITION_VERBS, STRUCTURAL_WORDS


def normalized(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[^\S ]\s*| \s+", " "))  # a lone blank stays


def trimmed(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def match_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def any_of(words: list[str]) -> str:
    """A pattern for any of some words or phrases, as a tree by their letters, so that a text is not tried against each of them at every place."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def told(node: dict) -> str:
        ways = [(c if c.isalnum() or c == " " else "\\" + c) + told(n) for c, n in node.items() if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})?" if "" in node else ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return begun(tree, told(tree))


#: Other characters that count as a letter when case doesn't.
_FOLDED = {"i": "ıİ", "s": "ſ", "k": "\u212a"}


def begun(letters, pattern: str) -> str:
    """A pattern that is only tried where one of the letters stands, with which all its matches begin."""
    return "(?=[" + "".join(c if c.isalnum() else "\\" + c for c in letters if c) + f"]){pattern}"


def sooner(pattern: str) -> str:
    """A pattern that finds the same, tried only at the letters with which its matches begin, where it tells them: flags and a word's edge before a word or a group of words."""
    bare = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    while "(" in bare and bare != (less := re.sub(r"\([^()]*\)", "", bare)):
        bare = less
    found = re.match(r"(\(\?[a-zA-Z]+\))?(?:\(\?<![^()]*\))?\\b(?:([A-Za-z])(?![?*{])|\((?:\?:)?([A-Za-z][A-Za-z? |]*)\)(?![?*{]))", pattern)
    if found is None or "|" in bare:
        return pattern
    flags, one, several = found.groups()
    starts = {w[:1] for w in (several or one).split("|")}
    if any(not w[:1].isalpha() or w[1:2] == "?" for w in (several or one).split("|")):
        return pattern
    if "i" in (flags or ""):
        starts = {x for c in starts for x in c.lower() + c.upper() + _FOLDED.get(c.lower(), "")}
    return begun(sorted(starts), pattern)


def literal_in(pattern: str) -> str | None:
    """Letters and blanks that stand in every match of a pattern, case aside and in lower case (see ``folded``); None where none are told."""
    if r"\Q" in pattern or re.search(r"\(\?[a-zA-Z]*x", pattern):
        return None
    bare = re.sub(r"\[[^\]]*\]", "\0", re.sub(r"\\[pP]\{[^}]*\}|\\x..|\\u....|\\k<[^>]*>|\\.", "\0", pattern))
    while "(" in bare and bare != (less := re.sub(r"\([^()]*\)", "\0", bare)):
        bare = less
    if set("|()[]") & set(bare):
        return None
    found = [run[:-1] if bare[m.end() : m.end() + 1] in ("?", "*", "{") else run for m in re.finditer("[A-Za-z ]+", bare) for run in [m[0]]]
    longest = max(found, key=len, default="").lower()
    return longest if len(longest) >= 3 else None


def folded(text: Column) -> Column:
    """A text in lower case, with the characters that patterns take for ASCII letters when case doesn't count as those letters."""
    return F.lower(F.translate(text, "ıİſ\u212a", "iisk"))


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^0-9a-z]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Parts at blank lines and after sentence ends."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n|(?<=[.!?])\s+"), F.trim), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Distinct ASCII words of three letters or more, lower-cased, without structural words; glued sentences are split."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z](?:[A-Za-z'’-]*[A-Za-z])?)"), 1)), F.lower)  # a full stop is in no word
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(STRUCTURAL_WORDS)))


def is_noise(text: Column) -> Column:
    """Nothing in it counts: no letter, digit, percent, ampersand or currency sign."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}%&$€£¥]")


def is_bracket_only(text: Column) -> Column:
    return normalized(text).rlike(r"^[\[\](){}〈〉《》]+$")


def is_wordlike(text: Column, most: int = 80) -> Column:
    t = F.trim(text)
    return (F.length(t) <= most) & ~t.rlike(r"(?U)\s") & t.rlike(r"\p{L}")


def orthographic_key(text: Column) -> Column:
    """What is left of a text when white space, zero-width blanks and case don't count."""
    return F.lower(normalized(F.regexp_replace(text, "[\\u200b\\u200c\\u200d\\ufeff]", "")))


def needs_space(before: Column, after: Column) -> Column:
    """Whether a blank is missing between two pieces of text that follow each other. A full stop after a single capital, an
    abbreviation or a title ends no sentence."""
    letter, upper = r"^\p{L}", r"^\p{Lu}"
    abbreviation = before.rlike(r"(?:(?:^|\s)(?:Mr|Ms|Dr|No|Art|Co|Ltd|Inc)|(?U:\b)[A-Z])\.\z") | reduce(lambda c, a: c | before.endswith(a), ABBREVIATIONS, F.lit(False))
    return (
        (before.rlike(r"\p{L}\z") & after.rlike(r"^[\p{L}(]"))
        | (before.rlike(r"[);,:]\z") & after.rlike(letter))
        | (before.rlike(r"\.\z") & after.rlike(upper) & ~abbreviation)
        | (before.rlike(r"\p{N}\z") & after.rlike(upper))
    )


def quotes_balanced(text: Column) -> Column:
    return match_count(text, "“") == match_count(text, "”")


def tri_state(value: Column) -> Column:
    """On, off or absent: false, 0 and off are off, null is absent, the rest is on."""
    return F.when(value.isNull(), F.lit(None)).otherwise(~F.lower(value).isin("false", "0", "off"))


def quoted_phrases(text: Column) -> Column:
    """Phrases within double quotes, smart quotes or guillemets of five words or more, and single-quoted ones of two or more."""
    long = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in ('"([^"]+)"', "“([^”]+)”", "«([^»]+)»")])
    short = F.regexp_extract_all(text, F.lit("‘([^’]+)’"), 1)
    n = lambda p: F.size(F.split(F.trim(p), r"(?U)\s+"))
    return F.concat(F.filter(long, lambda p: n(p) >= 5), F.filter(short, lambda p: n(p) >= 2))


def defined_term(text: Column) -> Column:
    """The quoted term, closed within 80 characters, that a definition begins with; else null."""
    term = F.regexp_extract(text, r'^\s*["“«]([^"”»]{1,80})["”»]\s*:?\s*\S.{4,}', 1)
    return F.when(term != "", term)


def has_definition_verb(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:" + "|".join(DEFINITION_VERBS) + r")\b")


def context(text: Column, found: Column, radius: int = 40) -> Column:
    """What stands around the first place of a found string, on one line."""
    at = F.position(found, text)
    start = F.greatest(F.lit(1), at - radius)
    return F.translate(F.substring(text, start, at + F.length(found) + radius - start), "\n", " ")


def replace_all(text: Column, replacements: list[tuple[str, str]]) -> Column:
    """Replacements one after another, top to bottom."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), replacements, text)
