"""Passes over pieces: across joints, on parts, and against the passes over uncut texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paragrid.operators import normalize, postprocess
from paragrid.sources import packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
KIND = "array<struct<tag:string,text:string>>"


def applied(spark, step, many):
    rows = spark.createDataFrame([(k, [("t", t) if isinstance(t, str) else t for t in x]) for k, x in enumerate(many)], f"k int, ps {KIND}").select("k", step(F.col("ps")).alias("x"))
    return [[t for _, t in x] for _, x in sorted((r["k"], r["x"]) for r in rows.collect())]


def test_joints(spark):
    assert applied(spark, postprocess.spacing, [["one", "two", ""], ["one,", "", "two", " three"], [("delText", "the"), "Bank"], ["S.p.A.", "Bank"]]) == [["one", " two", ""], ["one,", "", " two", " three"], ["the", " Bank"], ["S.p.A.", "Bank"]]
    assert applied(spark, postprocess.verbs_apart, [["“A”", "means x"], ["“A” ", "means x"], ["A", ("delText", " "), "shall mean"], ["means"]]) == [["“A”", " means x"], ["“A” ", "means x"], ["A", " ", " shall mean"], ["means"]]
    assert applied(spark, postprocess.doubled_apart, [["of the Seller,", "  ", "(Seller pays"], ["all", "All"], ["up to", "to go"]]) == [["of the Seller,", "  ", " pays"], ["all", " "], ["up to", "to go"]]


def quotes_by_hand(texts):
    texts = list(texts)
    if not any(v in "".join(texts) for v in ("means", "shall mean", "has the meaning", "indicates")):
        return texts
    for i, t in enumerate(texts):
        after = next((x for x in texts[i + 1 : i + 3] if x), "")
        before = "".join(texts[: i + 1])
        if t and not t.rstrip().endswith(("”", '"')) and after.lstrip().startswith(("means", "shall mean")) and before.count("“") + before.count("„") > before.count("”"):
            texts[i] = t.rstrip() + "”"
    return texts


def test_open_quotes_cross_pieces(spark):
    assert applied(spark, postprocess.quotes_closed, [["“Term ", "means x"], ["“", "Te", "rm", "", " means x"], ["“Term”", " means"], ["„Term", "", "", "means"]]) == [["“Term”", "means x"], ["“", "Te", "rm”", "", " means x"], ["“Term”", " means"], ["„Term", "", "", "means"]]
    r = random.Random(2)
    many = [[r.choice(["“A", "B ", "”", "means x", " shall mean", "", '"', "„C", "y"]) for _ in range(r.randint(0, 9))] for _ in range(300)]
    assert applied(spark, postprocess.quotes_closed, many) == [quotes_by_hand(x) for x in many]


def test_cut_citations_read_like_the_whole_text(spark):
    r = random.Random(7)
    words = ["Article 5", "Articles 6.1 and 7", "of the", "this", "Code", "Schedule", "above", "deed.", "Act!", "of", "the said"]
    whole = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(150)]
    cut = []
    for t in whole:  # between words only: what is cut itself is not found
        parts = t.split(" ")
        places = sorted(r.sample(range(1, len(parts)), min(len(parts) - 1, r.randint(0, 4))))
        places = [p for p in places if not parts[p - 1].startswith("Article")]
        cut.append([" ".join(parts[a:b]) + (" " if b < len(parts) else "") for a, b in zip([0, *places], [*places, len(parts)])])
    made = ["".join(x) for x in applied(spark, postprocess.articles("Clause"), cut)]
    rows = spark.createDataFrame(list(enumerate(whole)), "k int, t string").select("k", normalize.internal_articles(F.col("t")).alias("x"))
    assert made == [x for _, x in sorted(map(tuple, rows.collect()))]


def part(*paragraphs):
    return f"<w:document {W}><w:body>{''.join(paragraphs)}</w:body></w:document>"


def test_parts(spark):
    run = lambda t, props="": f"<w:r>{props}<w:t>{t}</w:t></w:r>"
    italic = "<w:rPr><w:i/></w:rPr>"
    xml = part(
        "<w:p>" + run("“Term") + "<w:r><w:br/><w:br/></w:r>" + run("means the the &amp; Bank") + "</w:p>",
        '<w:p><w:pPr><w:pStyle w:val="X"/><w:jc/></w:pPr>' + run("Schedule 1") + "</w:p>",
        "<w:p>" + run("Schedule A") + "</w:p>", "<w:p>" + run("Schedule one") + "</w:p>", '<w:p><w:pPr><w:pStyle w:val="TOC1"/></w:pPr>' + run("Schedule 2") + "</w:p>",
        "<w:p>" + run("body of four words", italic) + run("(in four words here)", italic) + run("x pro rata y", italic) + run("two words", italic) + "</w:p>",
        "<w:p>" + run("HEAD OF FOUR WORDS", italic) + "</w:p>", "<w:p><w:pPr><w:rPr><w:i/></w:rPr></w:pPr>" + run("body of four words", italic) + "</w:p>",
        "<w:p>" + run("see Article 5") + run(" of the Civil Code and Article 6 ") + '<w:del><w:r><w:delText>old</w:delText></w:r></w:del>' + run("of this deed") + "</w:p>",
    )
    parts = spark.createDataFrame([("p", "d", bytearray(xml.encode()), None), ("q", "d", bytearray(b"<bad"), None), ("e", "d", bytearray(part("<w:p/>").encode()), None)], "path string, part string, content binary, error string")
    changed, counts = postprocess.post_process(parts)
    (got,) = changed.collect()
    out = bytes(got["content"]).decode()
    assert [r[1] for r in packages.paragraph_rows(out.encode())][:1] == ["“Term”\n means the & Bank"] and out.count("<w:br/>") == 1
    assert '<w:pPr><w:pStyle w:val="X"/><w:pageBreakBefore/><w:jc/></w:pPr>' in out and "<w:p><w:pPr><w:pageBreakBefore/></w:pPr><w:r><w:t>Schedule A" in out and out.count("pageBreakBefore") == 2
    assert out.count("<w:i/>") == 6 and "<w:rPr></w:rPr><w:t>body of four words" in out
    assert "see Article 5" in out and "of the Civil Code and Clause 6 </w:t>" in out
    assert {(r["pass"], r["n"]) for r in counts.collect()} == {("spacing", 3), ("internal_articles", 1), ("doubled_words", 1), ("quotes", 1), ("line_break", 1), ("italic", 1), ("page_break", 2)}


def test_edits_follow_from_one_run_of_the_passes(spark):
    parts = spark.createDataFrame([("a", "word/document.xml", b"<x/>", None)], "path string, part string, content binary, error string")
    passed = postprocess.with_passes(postprocess.scan(parts))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(postprocess.edits(passed)).count("array_append(") <= plan(passed.select("after", "full", "changed")).count("array_append(")
