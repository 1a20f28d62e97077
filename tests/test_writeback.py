"""Packages to records, translated, and back to packages: untouched bytes stay, views read as translated."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
import pytest

from paragrid.operators import writeback
from paragrid.sources import markup, packages, tables

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:z="urn:z"><w:body>'
TAIL = "<z:odd  a='1>2' /><w:sectPr/></w:body></w:document>"
RECORD = "path string, part string, idx long, text string, en string, en_deleted string, en_segments array<struct<type:string,en:string>>, en_runs array<struct<start:int,end:int,bold:boolean,italic:boolean>>, runs array<struct<text:string,bold:boolean>>"


def run(text, props="", more=""):
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}<w:t xml:space=\"preserve\">{text}</w:t>{more}</w:r>"


def ins(inner):
    return f'<w:ins w:id="1" w:author="A. Person" w:date="2024-01-01T00:00:00Z">{inner}</w:ins>'


def dele(text, props=""):
    return f'<w:del w:id="2" w:author="B. Person"><w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:delText>{text}</w:delText></w:r></w:del>'


PLAIN = "<w:p><w:pPr><w:jc/></w:pPr>" + run("Il &lt;contratto&gt; ", '<w:sz w:val="22"/><w:lang w:val="it-IT"/>') + "<w:r><w:footnoteReference/></w:r>" + run("è firmato", "<w:b/>") + "<w:r><w:tab/></w:r></w:p>"
ANCHORED = "<w:p>" + run("uno", "", "<w:commentReference/>") + run("due") + "</w:p>"
NESTED = "<w:tbl><w:tr><w:tc><w:p>" + run("cella") + "</w:p></w:tc></w:tr></w:tbl>"
LINKED = "<w:p>" + run("vedi ") + "<w:hyperlink>" + run("qui") + "</w:hyperlink><w:smartTag>" + run(" ora") + "</w:smartTag></w:p>"
TRACKED = '<w:p><w:pPr><w:pStyle w:val="Corpo"/></w:pPr>' + run("Il prezzo è ") + ins(run("cento", "<w:i/>") + run(" euro", "<w:b/>")) + dele("mille lire") + run(" oggi") + "</w:p>"
FOLDING = "<w:p>" + run("a ") + ins(run("perche")) + dele("perché") + run(" b") + ins(run(" ")) + dele("y") + run("c") + "</w:p>"


def write(tmp_path, name, *paragraphs, more=()):
    with zipfile.ZipFile(tmp_path / name, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", HEAD + "".join(paragraphs) + TAIL)
        for part, content in more:
            z.writestr(part, content)


def applied(spark, tmp_path, records):
    found = packages.packages(spark, str(tmp_path))
    path = {r["path"].rsplit("/", 1)[1]: r["path"] for r in found.collect()}
    full = [(path[r[0]], *r[1:], *[None] * (9 - len(r))) for r in records]
    made, report = writeback.apply_to_packages(found, spark.createDataFrame(full, RECORD))
    out = {r["path"].rsplit("/", 1)[1]: r["content"] for r in made.collect() if r["error"] is None}
    return out, sorted((r["path"].rsplit("/", 1)[1], r["idx"], r["status"]) for r in report.collect())


def main_part(content):
    return zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()


def views(spark, content):
    rows = packages.paragraph_rows(content.encode())
    accept = {r[0]: r[1] for r in rows}
    reject = {r[0]: "".join(t for k, t in r[9] if k in ("regular", "del")) for r in rows if r[9]}
    return accept, reject


def test_plain_paragraphs(spark, tmp_path):
    write(tmp_path, "a.docx", PLAIN, ANCHORED, NESTED, LINKED, "<w:p/>", "<w:p>" + run("uguale") + "</w:p>", more=[("word/media/x.png", b"\x89PNG")])
    records = [("a.docx", None, 0, "Il <contratto> è firmato", "The <contract>\tis & signed"), ("a.docx", None, 1, "unodue", "one two"), ("a.docx", None, 2, "cella", "cell"), ("a.docx", None, 7, "vedi qui ora", "see here\nnow"), ("a.docx", None, 5, "uguale", "uguale"), ("a.docx", None, 8, "manca", "missing"), ("a.docx", None, 9, "x", " ")]
    out, report = applied(spark, tmp_path, records)
    xml = main_part(out["a.docx"])
    accept, _ = views(spark, xml)
    assert accept == {0: "The <contract>\tis & signed\t", 1: "one two", 2: "cell", 3: "see here\nnow", 5: "uguale"}
    assert [s for *_, s in report] == ["applied", "applied", "applied", "same", "moved", "missing", "empty"]
    assert "<w:footnoteReference/>" in xml and "<w:commentReference/>" in xml and "hyperlink" not in xml and "it-IT" not in xml
    assert xml.startswith(HEAD) and xml.endswith("<w:p/><w:p>" + run("uguale") + "</w:p>" + TAIL)
    assert re.search(r'<w:rPr><w:b w:val="0"/><w:bCs w:val="0"/><w:i w:val="0"/><w:iCs w:val="0"/><w:sz w:val="22"/></w:rPr><w:t>The &lt;contract&gt;</w:t>', xml)
    assert zipfile.ZipFile(io.BytesIO(out["a.docx"])).read("word/media/x.png") == b"\x89PNG"


def test_formats(spark, tmp_path):
    write(tmp_path, "a.docx", "<w:p>" + run("Titolo", "<w:b/>") + "</w:p>", "<w:p>" + run("def") + "</w:p>", "<w:p>" + run("gamme") + "</w:p>")
    records = [("a.docx", None, 0, "Titolo", "Heading", None, None, None, [("Titolo", True)]), ("a.docx", None, 1, "def", "“Term” means this"), ("a.docx", None, 2, "gamme", "one two", None, None, [(0, 3, False, True), (3, 7, True, False)])]
    xml = main_part(applied(spark, tmp_path, records)[0]["a.docx"])
    bold = [(t, b, i) for _, text, *_, runs, _ in packages.paragraph_rows(xml.encode()) for _, _, t, b, i, *_ in runs]
    assert bold == [("Heading", True, False), ("“", False, False), ("Term", True, False), ("” means this", False, False), ("one", False, True), (" two", True, False)]


def test_revisions_stay_in_place(spark, tmp_path):
    write(tmp_path, "a.docx", TRACKED, FOLDING, TRACKED.replace("oggi", "domani"))
    segments = [("regular", "The price is "), ("ins", "one hundred euro"), ("del", "a thousand lire"), ("regular", " today")]
    records = [("a.docx", None, 0, "Il prezzo è cento euro oggi", "The price is one hundred euro today", "", segments), ("a.docx", None, 1, "a perche b c", "a because b c", None, [("regular", "a "), ("ins", "because"), ("del", "because"), ("regular", " b"), ("ins", None), ("del", "y"), ("regular", "c")]), ("a.docx", None, 2, "Il prezzo è cento euro domani", "The price is one hundred euro tomorrow", "a thousand lire")]
    out, report = applied(spark, tmp_path, records)
    xml = main_part(out["a.docx"])
    accept, reject = views(spark, xml)
    assert accept[0] == "The price is one hundred euro today" and reject[0] == "The price is a thousand lire today"
    assert '<w:ins w:id="1" w:author="A. Person" w:date="2024-01-01T00:00:00Z"><w:r><w:t xml:space="preserve"> </w:t>' not in xml
    assert accept[1] == "a because b c" and reject[1] == "a because b yc"
    assert accept[2] == "The price is one hundred euro tomorrow" and "a thousand lire" in reject[2]
    assert {s for *_, s in report} == {"applied"} and xml.count('w:author="A. Person" w:date="2024-01-01T00:00:00Z"') >= 2
    assert '<w:rPr><w:b w:val="0"/><w:i/></w:rPr>' in xml and "<w:b/>" not in xml and '<w:pStyle w:val="Corpo"/>' in xml
    assert "<w:r><w:t>because</w:t></w:r>" in xml  # one text inserted and deleted is no revision


def test_errors_and_nothing_to_do(spark, tmp_path):
    write(tmp_path, "good.docx", "<w:p>" + run("uno") + "</w:p>")
    with zipfile.ZipFile(tmp_path / "bad.docx", "w") as z:
        z.writestr("word/document.xml", HEAD + "<w:p>")
    out, report = applied(spark, tmp_path, [("bad.docx", None, 0, "uno", "one"), ("good.docx", None, 0, "altro", "other")])
    assert report == [("bad.docx", 0, "missing"), ("good.docx", 0, "missing")]
    assert main_part(out["good.docx"]) == main_part((tmp_path / "good.docx").read_bytes())


def test_splice(spark):
    parts = spark.createDataFrame([("p", "a", bytearray(b"0123456789"), None), ("p", "b", bytearray(b"xy"), None), ("p", "c", bytearray(b"xyz"), None)], "path string, part string, content binary, error string")
    edits = [("p", "a", 2, 4, b"AB"), ("p", "a", 4, 4, b"+"), ("p", "a", 2, 3, b"lost"), ("p", "a", 10, 10, b"!"), ("p", "a", 0, 0, b"<"), ("p", "c", 0, 2, b""), ("p", "c", 1, 3, b"")]
    rows = spark.createDataFrame([(*e[:4], bytearray(e[4])) for e in edits], markup.EDIT)
    got = {r["part"]: (bytes(r["content"]), r["error"]) for r in markup.splice(parts, rows).collect()}
    assert got["a"] == (b"<01AB+456789!", None) and "b" not in got and got["c"][0] == b"xyz" and "overlaps" in got["c"][1]


def test_scan_handles_other_prefixes_and_encodings():
    xml = b'<?xml version="1.0" encoding="UTF-8"?><x:p xmlns:x="' + markup.NAMESPACE.encode() + b'"><x:r><x:t a="&gt;>">\xc3\xa9&amp;</x:t></x:r></x:p>'
    p = markup.tree(xml)
    x = writeback.Paragraph(xml, p)
    assert x.text == "é&" and x.element("b") == b"<x:b/>"
    leaf = p.children[0].children[0]
    assert x.leaf(leaf, " z<") == (leaf.start, leaf.end, b'<x:t a="&gt;>" xml:space="preserve"> z&lt;</x:t>')
    with pytest.raises(Exception):
        markup.tree(xml.replace(b"UTF-8", b"ISO-8859-1"))


def test_kept_texts_are_those_of_the_tree():
    boxed = "<w:p>" + run("out ") + "<w:r><w:pict><z:box><w:p>" + run("in") + dele("gone") + "<w:r><w:br/><w:cr/></w:r></w:p></z:box></w:pict><w:t>er</w:t><w:br w:type='page'/><w:tab/></w:r></w:p>"
    moved = '<w:p><w:pPr><w:rPr><w:ins/></w:rPr><w:r><w:t>no</w:t></w:r></w:pPr><w:moveTo>' + run("to") + "<w:del>" + run("x") + "</w:del></w:moveTo><w:moveFrom>" + run("from") + "<w:ins>" + run("y") + "</w:ins></w:moveFrom><w:r><z:t>z</z:t><w:t>a<w:t>b</w:t>c</w:t></w:r><w:t>bare</w:t></w:p>"
    for part in [HEAD + p + TAIL for p in (PLAIN, ANCHORED, NESTED, LINKED, TRACKED, FOLDING, boxed, moved, "", "<w:p/>")]:
        xml = part.encode()
        assert markup.kept_texts(xml) == ["".join(markup.piece(r) for r, kind, _ in markup.own(p) if kind in ("regular", "ins")) for p in markup.paragraphs_of(xml)]
    for bad in (b"<a>", b'<?xml version="1.0" encoding="latin-1"?><a/>'):
        with pytest.raises(markup.expat.ExpatError):
            markup.kept_texts(bad)


def test_values_of_nested_columns():
    rows = [None, [], [{"a": 1, "b": [None, "x"]}, None, {"a": None, "b": None}], [{"a": 2, "b": []}]]
    column = pa.array(rows, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.list_(pa.string()))])))
    assert all(tables.python_values(column.slice(at, n)) == column.slice(at, n).to_pylist() for at in range(5) for n in range(5))


def test_parts_are_edited_where_their_records_are(spark, tmp_path, monkeypatch):
    """Edits are no rows that travel to the parts once more, and records of another part of the same letters do not reach it."""
    def no_rows(*_):
        raise AssertionError("edits became rows")

    monkeypatch.setattr(markup, "splice", no_rows)
    monkeypatch.setattr(writeback, "splice", no_rows, raising=False)
    content = (HEAD + PLAIN.replace("Il ", "In ") + FOLDING + TAIL).encode()
    parts = spark.createDataFrame([("a", "b\nc", content, None), ("a\nb", "c", content, None), ("d", "e", b"<w", None)], packages.PART)
    texts = markup.kept_texts(content)
    records = spark.createDataFrame([("a", "b\nc", 0, texts[0], "first", None, None, None, None), ("d", "e", 0, "x", "y", None, None, None, None), (None, "b", 0, texts[0], "no", None, None, None, None)], RECORD)
    changed, report = writeback.write_back(parts, records)
    assert [(r["path"], r["part"], r["error"]) for r in changed.collect()] == [("a", "b\nc", None)]
    assert sorted(str((r["path"], r["status"])) for r in report.collect()) == ["('a', 'applied')", "('d', 'missing')", "(None, 'missing')"]
