"""Records, streams and notes of packages, and one table of texts from packages, parts and record files."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from paragrid.sources import extraction

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PART = "path string, part string, content binary, error string"
run = lambda t, tag="t": f"<w:r><w:{tag}>{t}</w:{tag}></w:r>"
ins, dele = lambda t: f"<w:ins>{run(t)}</w:ins>", lambda t: f"<w:del>{run(t, 'delText')}</w:del>"
BODY = [
    f'<w:p><w:pPr><w:pStyle w:val="S"/><w:rPr><w:b w:val="0"/><w:i/></w:rPr></w:pPr>{run("a ")}{ins("P")}{ins("S")}{dele("x")}{dele("y")}{dele("z")}<w:bookmarkStart/>{dele("w")}{run(" b")}</w:p>',
    f"<w:p>{run('plain')}</w:p>", "<w:p/>", f"<w:p>{dele('gone')}</w:p>", f"<w:p><w:ins><w:del>{run('phantom', 'delText')}</w:del></w:ins>{run('r')}</w:p>",
]
DOC = f"<w:document {W}><w:body>{''.join(BODY)}</w:body></w:document>"


def frame(spark, **contents):
    return spark.createDataFrame([("p", f"word/{n}.xml", bytearray(x.encode()), None) for n, x in contents.items()], PART)


def test_records(spark):
    got = {r["idx"]: r for r in extraction.records(frame(spark, document=DOC)).collect()}
    assert sorted(got) == [0, 1, 3, 4]
    assert (got[0]["text"], got[0]["deleted_text"], got[0]["style"], got[0]["p_rpr_b"], got[0]["p_rpr_i"], got[0]["has_track_changes"]) == ("a PS b", "xyzw", "S", "false", "true", True)
    assert [tuple(s) for s in got[0]["tc_segments"]] == [("regular", "a "), ("ins", "PS"), ("del", "xyzw"), ("regular", " b")]
    assert [tuple(h) for h in got[0]["tc_cluster_hits"]] == [("ins", 2), ("del", 3)]
    assert (got[1]["tc_segments"], got[1]["tc_cluster_hits"], got[1]["has_track_changes"], got[3]["deleted_text"]) == (None, None, False, "gone")
    assert [tuple(s) for s in got[4]["tc_segments"]] == [("ins_then_del", "phantom"), ("regular", "r")]


def test_streams(spark):
    got = [(r["field"], r["seq"], r["text"]) for r in extraction.streams(frame(spark, document=DOC, header1="<bad")).orderBy(F.desc("field"), "seq").collect()]
    assert got == [("t", 0, "a "), ("t", 1, "P"), ("t", 2, "S"), ("t", 3, " b"), ("t", 4, "plain"), ("t", 5, "r"), ("delText", 0, "x"), ("delText", 1, "y"), ("delText", 2, "z"), ("delText", 3, "w"), ("delText", 4, "gone"), ("delText", 5, "phantom")]


def test_notes(spark):
    notes = f'<w:footnotes {W}><w:footnote w:type="separator" w:id="-1"><w:p>{run("line")}</w:p></w:footnote><w:footnote w:id="2"><w:p>{run("one ")}{run("two")}</w:p></w:footnote><w:footnote w:id="3"><w:p/></w:footnote></w:footnotes>'
    comments = f'<w:comments {W}><w:comment w:id="0"><w:p>{run("hm")}</w:p></w:comment></w:comments>'
    found = frame(spark, footnotes=notes, comments=comments, document=DOC, endnotes="<bad")
    assert {(r["kind"], r["id"], r["text"]) for r in extraction.notes(found).collect()} == {("footnote", "2", "one two"), ("comment", "0", "hm")}
    assert {r["part"]: r["n"] for r in extraction.note_counts(found).collect()} == {"word/footnotes.xml": 1, "word/comments.xml": 1}


def test_extract(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOC)
    (tmp_path / "b.xml").write_text(f"<w:p {W}>{run('bare')}{dele('old')}</w:p>")
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.json").write_text(json.dumps([{"idx": 4, "en": "said", "en_deleted": " ", "en_segments": [{"type": "ins", "en": "x"}, {"type": "del", "en": ""}]}]))
    got = {(r["path"].rsplit("/", 1)[1], r["field"], r["idx"], r["text"]) for r in extraction.extract(spark, str(tmp_path)).collect()}
    assert {g for g in got if g[0] != "a.docx"} == {("b.xml", "t", 0, "bare"), ("b.xml", "delText", 0, "old"), ("d.json", "en", 4, "said"), ("d.json", "en_segments[0]", 4, "x")}
    assert ("a.docx", "delText", 5, "phantom") in got and len([g for g in got if g[0] == "a.docx"]) == 12
