"""Citations of articles: which stay, which become clauses or sections; spellings of both trees."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paragrid.functions.rules import INTERNAL_ANCHORS, INTERNAL_DETERMINERS, INTERNAL_LOCATORS
from paragrid.operators import normalize

KEPT = [
    "Article 2482-bis, first paragraph, of the Italian Civil Code", "Article 5 et seq. of the Civil Code", "Article 5 or 6 of the Civil Code", "Article 7 TUB applies", "Article 10:5 letter b) of Decree 4",
    "Articles 5 and Article 6 of the Penal Act", "Article 12-bis of Law No. 5", "Article 3 of the Regulation", "Article 5 (this Deed)", "Article 9 of Directive 2004/25, as said in this deed",
]
CHANGED = [
    ("Article 5 of this Agreement", "Clause 5 of this Agreement"), ("Article 5 of the present Deed", "Clause 5 of the present Deed"), ("Articles  5 and 6 above, of the Act", "Clauses 5 and 6 above, of the Act"), ("Article 5 of Schedule B", "Clause 5 of Schedule B"),
    ("see Article 4.", "see Clause 4."), ("(Article 12-bis) and so on. The Code", "(Clause 12-bis) and so on. The Code"), ("Article 3 hereof", "Clause 3 hereof"), ("Article 4\nThe Civil Code", "Clause 4\nThe Civil Code"),
    ("Article 1 of the Civil Code! Article 2 of this Deed", "Article 1 of the Civil Code! Clause 2 of this Deed"), ("Particle 5", "Particle 5"), ("Article 5 " + "word " * 60 + "Code", "Clause 5 " + "word " * 60 + "Code"),
]


def rewritten(spark, texts, f=normalize.internal_articles):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", f(F.col("t")).alias("x"))
    return [x for _, x in sorted(map(tuple, rows.collect()))]


def outside(text, at):
    """The rule, read word by word."""
    tail = text[at : at + 250]
    end = re.search(r"[!?\n]|\.(?= *[A-ZÀ-ÞĀ])|\.\Z", tail)
    tail, pos = tail[: end.start()] if end else tail, 0
    while pos < len(tail):
        chained, word = re.compile(r"\bArticles?\s+\d[\d.:]*(?:-[A-Za-z]{1,15})*").match(tail, pos), re.compile(r"[A-Za-z][A-Za-z0-9'\-]*").match(tail, pos)
        if chained or not word:
            pos = chained.end() if chained else pos + 1
            continue
        pos = word.end()
        if word[0].lower() in INTERNAL_LOCATORS:
            return False
        if word[0][0].isupper():
            before = tail[: word.start()].rstrip().lower()
            return not (word[0] in INTERNAL_ANCHORS or any(before == d or before.endswith(" " + d) for d in INTERNAL_DETERMINERS))
    return False


def by_the_rule(text):
    return re.sub(r"\bArticle(s?)\s+(\d[\d.:]*(?:-[A-Za-z]{1,15})*)", lambda m: m[0] if outside(text, m.end()) else f"Clause{m[1]} {m[2]}", text)


def test_citations(spark):
    assert rewritten(spark, KEPT) == KEPT == [by_the_rule(t) for t in KEPT]
    assert rewritten(spark, [a for a, _ in CHANGED]) == [b for _, b in CHANGED] == [by_the_rule(a) for a, _ in CHANGED]
    assert rewritten(spark, [None, "", "Article"]) == [None, "", "Article"]


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_rule(spark, seed):
    r = random.Random(seed)
    words = ["Article 5", "Articles 6.1", "Article 12-bis", "and", "of", "the", "this", "the said", "The", "Code", "Schedule", "above", "seq.", "5th", "(b)", "Act.", "deed.", "é", "Éx", "that precedes", "a\nb", "1.2", "-", "said", "Article", "x!"]
    texts = [r.choice(["", " "]).join([""] + [r.choice(words) + r.choice([" ", " ", "  ", ", "]) for _ in range(r.randint(1, 14))]) for _ in range(300)]
    assert rewritten(spark, texts) == [by_the_rule(t) for t in texts]


def test_trees_and_variants(spark):
    texts = ["whilst ploughing Article 5 of this deed, authorise a cheque", "plow the color, authorize molds"]
    step = lambda variant, tree: [r["text"] for r in normalize.apply_passes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), normalize.passes(variant, tree)).orderBy("k").collect()]
    assert step("us", "us") == ["while plowing Section 5 of this deed, authorize a check", "plow the color, authorize molds"]
    assert step("uk", "us") == ["whilst ploughing Clause 5 of this deed, authorise a cheque", "plough the color, authorise moulds"]
    assert step("us", "uk")[0] == "whilst ploughing Clause 5 of this deed, authorize a cheque" and step("uk", "uk")[1] == "plow the color, authorise molds"
