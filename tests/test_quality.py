"""Quality checks one by one: what each reports, and what it lets pass."""

import re

from pyspark.sql import functions as F

from paragrid.functions.text import any_of, folded, literal_in
from paragrid.operators import normalize, quality


def lines(spark, *texts):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, idx int, text string")


#: (check, text, number of findings)
CASES = [
    ("definition_boundary", "the “Buyer”means a party, Xmeans and a means", 2),
    ("double_punctuation", "a:: b:: c,, d", 2),
    ("double_punctuation", "a: b, c; d.", 0),
    ("terminology", "a credit line and a cash line", 2),
    ("standalone_financing", "Project Financing", 0),
    ("standalone_financing", "the Financing", 1),
    ("doubled_word", "had had that that the The office", 1),
    ("doubled_word", "it is is so", 0),
    ("quotes", "“Buyer means the one who buys", 2),
    ("quotes", "“Buyer” means the one who buys", 0),
    ("quotes", "an open “ without a verb", 0),
    ("title", "The Deed of Creation of Mortgage", 1),
    ("word_order", "all rights existing and future, any existing and future", 1),
    ("spelling", "we authorize and authorize a center of labor", 2),
    ("article_reference", "see Article 5.1 and Articles 12", 2),
    ("article_reference", "see Article 5 of the Civil Code", 0),
    ("that_precedes", "That precedes, that follow, that follows from it", 2),
    ("truncation", "the goods are to be delivered by the", 1),
    ("truncation", "the goods are to be delivered; and", 0),
    ("truncation", "TBD the goods are to be delivered by the", 0),
    ("truncation", "_the goods are to be delivered by the", 0),
    ("truncation", "delivered by the", 0),
]


def test_each_check(spark):
    rows = lines(spark, *[t for _, t, _ in CASES], None, "")
    found = {(r["idx"], r["check"]): r["n"] for r in quality.check_paragraphs(rows, shortest_doubled=3).collect()}
    assert [(c, t, found.get((k, c), 0)) for k, (c, t, _) in enumerate(CASES)] == CASES
    assert not [k for k in found if k[0] >= len(CASES)]  # null and empty texts have no findings


def test_spelling_of_the_other_variant(spark):
    found = {r["check"] for r in quality.check_paragraphs(lines(spark, "we authorise a centre"), variant="us").collect()}
    assert "spelling" in found and quality.check_paragraphs(lines(spark, "we authorize a center"), variant="us").where("check = 'spelling'").count() == 0


def test_boundaries(spark):
    pieces = lines(spark, "ends here", "Here", "", None, " again", "  ", "(again so", "No.", "Five", "J.", "Doe", "end\n", "x", "5", "Days")
    got = sorted((r["idx"], r["check"]) for r in quality.boundary_findings(pieces).collect())
    assert got == [(1, "doubled_across"), (1, "spacing"), (6, "doubled_across"), (7, "spacing"), (9, "spacing"), (11, "spacing"), (14, "spacing")]


def test_truncated_pairs(spark):
    pairs = spark.createDataFrame([("x" * 31, " "), ("x" * 30, None), ("x" * 51, "y" * 20), ("x" * 51, "y" * 21), ("x" * 50, "y"), (None, "y"), (" " * 60, "y")], "text string, en string")
    assert [r["fault"] for r in quality.truncated_pairs(pairs).collect()] == ["empty", "short"]


def test_literal_terms(spark):
    rows = lines(spark, "Business Register, the credit lines that follow, all (Parti) and Financing", "“Parte” who intervenes as $1", None, "nothing")
    got = [r["t"] for r in rows.orderBy("idx").select(normalize.terminology(F.col("text")).alias("t")).collect()]
    assert got == ["Companies Register, the credit facilities below, all (Parti) and Facility", "“Party” acting as $1", None, "nothing"]


def test_formatting(spark):
    kind = "path string, idx int, text string, p_italic boolean, runs array<struct<text:string,bold:boolean,italic:boolean>>"
    run = lambda t, bold=False, italic=False: (t, bold, italic)
    rows = [
        ("p", 0, "“Buyer” means a party", None, [run("“Buyer”"), run(" means a party")]),
        ("p", 1, "“Buyer” means a party", None, [run("“Buyer”", bold=True), run(" means a party")]),
        ("p", 2, "“Buyer” means\na party", None, [run("“Buyer”", bold=True)]),
        ("p", 3, "one two three", None, [run("one two three", italic=True)]),
        ("p", 4, "one two three", True, [run("one two three", italic=True)]),
        ("p", 5, "x pro rata y", None, [run("x pro rata y", italic=True)]),
        ("p", 6, "(one two three)", None, [run("(one two three)", italic=True)]),
        ("p", 7, "ONE TWO THREE", None, [run("ONE TWO THREE", italic=True)]),
        ("p", 8, None, None, None),
    ]
    got = [(r["idx"], r["fault"]) for r in quality.formatting(spark.createDataFrame(rows, kind)).orderBy("idx").collect()]
    assert got == [(0, "definition_not_bold"), (2, "definition_line_break"), (3, "italic_run")]


def test_only_the_checks_that_are_asked_for_are_computed(spark):
    rows = spark.createDataFrame([(1, 0, "word word again, see Article 5;; of assets existing and future and the")], "doc_id int, idx int, text string")
    found = quality.check_paragraphs(rows, only=["truncation"])
    assert [r["check"] for r in found.collect()] == ["truncation"]
    assert "doubled_word" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["check"]: r["n"] for r in quality.check_paragraphs(rows).collect()} == {"truncation": 1, "doubled_word": 1, "double_punctuation": 1, "article_reference": 1, "word_order": 1}


def test_patterns_that_find_the_same_sooner(spark):
    words = ["favor", "favored", "a.b", "honor"]
    texts = ["favored", "favors", "x favor y", "a.b", "axb", "hono honor", "", "FAVOR"]
    for t in texts:
        assert bool(re.search(rf"\b(?:{any_of(words)})\b", t)) == bool(re.search(r"\b(?:favor|favored|a\.b|honor)\b", t))
    cases = [(r"(?iU)\bthe present (?:deed|act)\b", "the present "), (r"\bgoods?\s+left\b", "good"), (r"(?iU)\b(?:a|b) c|dd\b", None), (r"(?m)^\s*(?:X|Y)\s*:\s*[A-Z]", None), (r"\p{Alpha}+\bkept", "kept"), (r"\Qabc\E", None)]
    assert [literal_in(p) for p, _ in cases] == [x for _, x in cases]
    rows = spark.createDataFrame([(t,) for t in ["In THE PRESENT act", "ın the name", "a Kin", "the ſame", None]], "text string")
    assert [r[0] for r in rows.select(folded(F.col("text"))).collect()] == ["in the present act", "in the name", "a kin", "the same", None]
