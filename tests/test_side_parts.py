"""Headers, footers and comments put back: fields stay byte for byte."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrid.operators import side_parts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PART = "path string, part string, content binary, error string"
ENTRY = f"path string, source string, p_idx int, text string, en string, fields {side_parts.FIELDS}"


def run(t):
    return f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>"


def field(kind, result, split=False):
    instruction = "".join(f"<w:r><w:instrText>{x}</w:instrText></w:r>" for x in ([f" {kind} ", "\\* MERGEFORMAT"] if split else [f" {kind} "]))
    cached = f'<w:r><w:fldChar w:fldCharType="separate"/></w:r>{run(result)}' if result is not None else ""
    return f'<w:r><w:fldChar w:fldCharType="begin"/></w:r>{instruction}{cached}<w:r><w:fldChar w:fldCharType="end"/></w:r>'


def part(*paragraphs):
    return f"<w:hdr {W}>{''.join(f'<w:p>{p}</w:p>' for p in paragraphs)}</w:hdr>"


FIELDED = run("Pagina ") + field("page", "7", split=True) + run(" di ") + run("tutte ") + field("NUMPAGES", "9") + run(" fine")
HEADER = part(run("Titolo") + run(" lungo"), " ", FIELDED, run("uguale"), field("DATE", None) + run("oggi"))


def frame(spark, **contents):
    return spark.createDataFrame([("p", f"word/{n}.xml", bytearray(x.encode()), None) for n, x in contents.items()], PART)


def test_rows_for_translators(spark):
    rows = side_parts.side_rows(frame(spark, header1=HEADER, footer2=part(run("piede")), header9="<bad", document=part(run("no")))).orderBy("idx").collect()
    assert [(r["idx"], r["source"], r["p_idx"], r["text"]) for r in rows] == [(0, "word/footer2.xml", 0, "piede"), (1, "word/header1.xml", 0, "Titolo lungo"), (2, "word/header1.xml", 2, "Pagina <<PAGE>> di tutte <<NUMPAGES>> fine"), (3, "word/header1.xml", 3, "uguale"), (4, "word/header1.xml", 4, "oggi")]
    assert [tuple(f) for f in rows[2]["fields"]] == [("PAGE", "7"), ("NUMPAGES", "9")] and rows[4]["fields"] == []


def applied(spark, contents, entries):
    made = side_parts.apply_side_rows(frame(spark, **contents), spark.createDataFrame([("p", *e) for e in entries], ENTRY))
    return {r["part"]: (bytes(r["content"]).decode(), r["n"]) for r in made.collect()}


def test_fields_stay_byte_for_byte(spark):
    entries = [("word/header1.xml", 0, "Titolo lungo", "Long & title", None), ("word/header1.xml", 2, "x", "Page <<PAGE>> of <<NUMPAGES>> end", [("PAGE", "7"), ("NUMPAGES", "9")]), ("word/header1.xml", 3, "uguale", "uguale", None), ("word/header1.xml", 99, "x", "y", None), ("word/footer2.xml", 0, "piede", " ", None)]
    got = applied(spark, {"header1": HEADER, "footer2": part(run("piede"))}, entries)
    keep = lambda t: run("X").replace("<w:t>X", f'<w:t xml:space="preserve">{t}')
    fields = field("page", "7", split=True), field("NUMPAGES", "9")
    want = part(keep("Long &amp; title") + run(""), " ", keep("Page ") + fields[0] + keep(" of ") + keep("") + fields[1] + keep(" end"), run("uguale"), field("DATE", None) + run("oggi"))
    assert got["word/header1.xml"] == (want, 2) and got["word/footer2.xml"] == (part(run("piede")), 0)


def test_marks_too_few_and_too_many(spark):
    entry = lambda en: applied(spark, {"header1": part(FIELDED)}, [("word/header1.xml", 0, "x", en, [("PAGE", "7")])])["word/header1.xml"][0]
    texts = lambda en: side_parts.told(side_parts.paragraphs_of(entry(en).encode())[0])[0]
    assert texts("only") == "only<<PAGE>><<NUMPAGES>>" and texts("a<<PAGE>>b<<PAGE>>c<<PAGE>>d") == "a<<PAGE>>b<<NUMPAGES>>cd"


def test_comments(spark):
    xml = f'<w:comments {W}><w:comment w:id="1"><w:p>{run("uno")}{run("due")}<w:del><w:r><w:delText>x</w:delText></w:r></w:del></w:p></w:comment><w:comment w:id="2"><w:p>{run("tre")}</w:p></w:comment><w:comment w:id="3"><w:p/></w:comment></w:comments>'
    given = spark.createDataFrame([("p", "1", "one <two>"), ("p", "3", "nothing holds it"), ("p", "2", None), ("q", "2", "other")], "path string, id string, en string")
    made, states = side_parts.apply_comments(frame(spark, comments=xml), given)
    (got,) = made.collect()
    assert bytes(got["content"]).decode() == xml.replace("<w:t>uno", '<w:t xml:space="preserve">one &lt;two&gt;').replace("<w:t>due", "<w:t>").replace("<w:delText>x", "<w:delText>")
    assert sorted(tuple(r) for r in states.collect()) == [("p", "1", "translated"), ("p", "2", "untranslated"), ("p", "3", "empty")]


def test_terms(spark):
    parts = frame(spark, header1=part(run("CONT") + run("RATTO") + run(" :"), run("Data e Data lunga")), footer1=part(run("nulla")))
    made = {r["part"]: bytes(r["content"]).decode() for r in side_parts.translate_terms(parts, [("Data", "Date"), ("Data lunga", "Long date"), ("Contratto", "Agreement")]).collect()}
    assert list(made) == ["word/header1.xml"]
    assert made["word/header1.xml"] == part(run("X").replace("<w:t>X", '<w:t xml:space="preserve">Agreement:'), run("Date e Long date"))


def test_edits_are_made_once(spark):
    parts = spark.createDataFrame([("a", "word/footer1.xml", b'<w:ftr xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>uno</w:t></w:r></w:p></w:ftr>', None)], "path string, part string, content binary, error string")
    entries = spark.createDataFrame([("a", "word/footer1.xml", 0, "uno", "one")], "path string, source string, p_idx int, text string, en string").withColumn("fields", F.array().cast(side_parts.FIELDS))
    made = side_parts.apply_side_rows(parts, entries)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the splicing
    assert [(r["n"], b">one<" in bytes(r["content"])) for r in made.collect()] == [(1, True)]
