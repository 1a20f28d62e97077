"""The package format and what is wired before packing."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from paragrid.sources import package_format, wiring

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOC = f"<w:document {W}><w:body><w:p><w:r><w:rPr/><w:t>one</w:t></w:r></w:p><w:p><w:r><w:rPr></w:rPr><w:t>two</w:t></w:r></w:p></w:body></w:document>"


def write(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)


@pytest.fixture
def folder(spark, tmp_path):
    package_format.register(spark)
    for k in range(5):
        write(tmp_path / f"d{k}.docx", **{"[Content_Types].xml": "<Types/>", "word/document.xml": DOC, "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>head {k}</w:t></w:r></w:p></w:hdr>", "word/media/a.png": f"{k}"})
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    return tmp_path


def read(spark, folder, **options):
    return spark.read.format(package_format.NAME).options(**options).load(str(folder))


def test_reads_parts_and_paragraphs(spark, folder):
    found = read(spark, folder, bytes_per_partition=900)
    assert found.rdd.getNumPartitions() > 1 and found.count() == 21
    assert [r["path"].rsplit("/", 1)[1] for r in found.where("error is not null").collect()] == ["bad.docx"]
    rows = read(spark, folder, rows="paragraphs").where("error is null").select(F.regexp_extract("path", "[^/]*$", 0).alias("p"), "part", "text").collect()
    assert sorted({(r["p"], r["text"]) for r in rows}) == sorted({(f"d{k}.docx", t) for k in range(5) for t in ("one", "two", f"head {k}")})


def test_filters_keep_members_from_being_read(spark, folder):
    found = read(spark, folder).where("part in ('word/header1.xml', 'word/none.xml')")
    assert sorted({r["part"] for r in found.collect()}) == ["word/header1.xml"] and found.count() == 5
    assert read(spark, folder).where("part = 'word/media/a.png' and length(content) = 1").count() == 5
    reader = package_format.Reader({"path": str(folder)})
    list(reader.pushFilters([package_format.EqualTo(("part",), "word/header1.xml")]))
    assert {r[1] for p in reader.partitions() for r in reader.read(p)} == {"word/header1.xml"}


def test_round_trip_and_final_names(spark, folder, tmp_path_factory):
    target = tmp_path_factory.mktemp("out")
    parts = read(spark, folder).where("error is null")
    package_format.for_packing(wiring.wired(parts)).write.format(package_format.NAME).mode("append").save(str(target))
    assert sorted(p.name for p in target.iterdir()) == [f"d{k}.docx" for k in range(5)]
    with zipfile.ZipFile(target / "d3.docx") as z:
        assert z.namelist()[0] == "[Content_Types].xml" and z.read("word/media/a.png") == b"3" and z.read("word/document.xml").decode() == DOC.replace("<w:rPr/>", "").replace("<w:rPr></w:rPr>", "")
    with pytest.raises(Exception, match="there already"):
        package_format.for_packing(parts).write.format(package_format.NAME).mode("append").save(str(target))
    package_format.for_packing(parts.where("path like '%d1.docx'")).write.format(package_format.NAME).mode("overwrite").save(str(target))
    assert len(list(target.iterdir())) == 5


def test_a_failed_task_leaves_nothing(spark, folder, tmp_path_factory):
    target = tmp_path_factory.mktemp("failed")
    parts = package_format.for_packing(read(spark, folder).where("error is null"))
    late = parts.withColumn("content", F.when(F.col("path").endswith("d4.docx") & (F.col("part") == "word/media/a.png"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception):
        late.write.format(package_format.NAME).mode("append").save(str(target))
    split = parts.repartition(7, "part")
    with pytest.raises(Exception, match="two tasks"):
        split.write.format(package_format.NAME).mode("append").save(str(target))
    assert list(target.iterdir()) == []


def test_wiring(spark):
    relation = lambda of, target: f'<Relationship Id="{of}" Target="{target}" Type="t"/>'
    parts = {
        "word/document.xml": "<d/>", "customXML/item1.xml": "1", "customXML/itemProps1.xml": "p", "customXML/_rels/item1.xml.rels": "<Relationships/>", "customXml/item2.xml": "orphan", "CUSTOMXML/ITEM1.xml": "twice",
        "word/_rels/document.xml.rels": relation("rId3", "/customXML/item1.xml") + relation("Rabc", "../customXml/item2.xml") + relation("Rdef", "styles.xml"), "word/settings.xml": '<w:a/><w:trackRevisions w:val="1"/><w:trackRevisions>x</w:trackRevisions>', "[Content_Types].xml": '<Override PartName="/customXML/item1.xml"/>',
    }
    rows = spark.createDataFrame([("p", n, bytearray(c.encode()), None) for n, c in parts.items()] + [("q", None, None, "BadZipFile")], "path string, part string, content binary, error string")
    got = {r["part"]: bytes(r["content"]).decode() for r in wiring.wired(rows).collect()}
    assert sorted(got, key=str.lower) == ["[Content_Types].xml", "customXml/_rels/item1.xml.rels", "customXml/ITEM1.xml", "customXml/itemProps1.xml", "word/_rels/document.xml.rels", "word/document.xml", "word/settings.xml"]
    assert got["word/_rels/document.xml.rels"] == relation("rId3", "../customXml/item1.xml") + relation("rId4", "styles.xml")
    assert got["word/settings.xml"] == "<w:a/>" and got["[Content_Types].xml"] == '<Override PartName="/customXml/item1.xml"/>' and "customXml/item2.xml" not in got


def test_gates(spark):
    parts = spark.createDataFrame([("p", "a", bytearray(b"1"), None), ("q", "a", bytearray(b"2"), None)], "path string, part string, content binary, error string")
    found = spark.createDataFrame([("p", "x", "BLOCK"), ("p", "b", "FAIL"), ("q", "x", "WARN")], "path string, check string, severity string")
    free, held = wiring.gated(parts, found)
    assert [r["path"] for r in free.collect()] == ["q"] and [tuple(r) for r in held.collect()] == [("p", ["b", "x"])]
