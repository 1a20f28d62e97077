"""The audit of packages: each step's rule, and one verdict for evidence in any order, in batch and as a stream."""

from __future__ import annotations

import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from paragrid.operators import diligence
from paragrid.sources import packages

NOW = datetime.datetime(2024, 1, 1, 12)


def steps(evidence):
    return {step: (severity, summary) for step, severity, summary in diligence.judge(evidence)}


def test_steps():
    final, source = ("final_part", diligence.MAIN), ("source_part", diligence.MAIN)
    assert {k: v[0] for k, v in steps({}).items()} == {"apply": "FAIL", "auxiliary": "N/A", "quality": "FAIL", "package": "N/A"}
    whole = {final: 5000, source: 1, ("source_part", "word/header1.xml"): 1, ("source_part", "word/comments.xml"): 1, ("final_part", "word/header1.xml"): 9, ("final_part", "word/comments.xml"): 9, ("quality", ""): 0, ("package", ""): 4000, ("package_part", diligence.MAIN): 1}
    assert {v[0] for v in steps(whole).values()} == {"PASS"} and steps(whole)["auxiliary"][1] == "2 present: comments, headers/footers"
    assert steps(whole | {final: 199})["apply"] == ("FAIL", "text of 199 bytes")
    assert steps({("final_part", "output.xml"): 900})["apply"] == ("WARN", "text at output.xml")
    less = {k: v for k, v in whole.items() if k != ("final_part", "word/comments.xml")}
    assert steps(less)["auxiliary"] == ("FAIL", "1 missing: comments")
    assert steps({final: 500, source: 1})["auxiliary"][0] == "N/A" and steps({source: 1})["auxiliary"] == ("FAIL", "nothing was written")
    assert steps(whole | {("quality", ""): 3})["quality"] == ("FAIL", "3 findings") and steps({final: 500})["quality"][0] == "WARN"
    assert steps(whole | {("package", ""): 10})["package"][1] == "result of 10 bytes" and steps(whole | {("package", ""): -1})["package"][1] == "the result is no archive"
    assert steps({k: v for k, v in whole.items() if k[0] != "package_part"})["package"][1] == "the result has no text"


def rows_of(seed):
    r = random.Random(seed)
    kinds = [("source_part", n) for n in (diligence.MAIN, "word/header1.xml", "word/numbering.xml")] + [("final_part", n) for n in (diligence.MAIN, "word/header1.xml", "word/numbering.xml")] + [("quality", None), ("package", None), ("package_part", diligence.MAIN)]
    made = [(f"p{r.randint(0, 5)}", *r.choice(kinds), r.choice([0, 3, 150, 5000]), NOW + datetime.timedelta(minutes=r.randint(0, 50))) for _ in range(80)]
    return made + [(None, "quality", None, 1, NOW), ("p1", None, None, 1, NOW)]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_for_replayed_and_unordered_batches(spark, tmp_path, seed):
    rows = rows_of(seed)
    batch = {tuple(r) for r in diligence.audit(spark.createDataFrame(rows, diligence.EVIDENCE)).collect()}
    r = random.Random(seed + 10)
    source, seen = tmp_path / "evidence", {}
    source.mkdir()
    pieces = [r.sample(rows, 25) for _ in range(3)] + [rows[k::3] for k in range(3)]  # some come twice, none in order

    def keep(df, _):
        for x in df.collect():
            if x["open"]:
                seen[x["path"], x["step"]] = (x["path"], x["step"], x["severity"], x["summary"])

    stream = diligence.follow(spark.readStream.schema(diligence.EVIDENCE).parquet(str(source)))
    for piece in pieces:
        spark.createDataFrame(piece, diligence.EVIDENCE).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    assert set(seen.values()) == batch


def test_state_expires(spark, tmp_path):
    source, ended = tmp_path / "evidence", []
    source.mkdir()
    stream = diligence.follow(spark.readStream.schema(diligence.EVIDENCE).parquet(str(source)), keep="1 day")
    keep = lambda df, _: ended.extend((x["path"], x["step"]) for x in df.where("not open").collect())
    for days in (0, 5, 6):
        spark.createDataFrame([(f"p{days}", "quality", None, 1, NOW + datetime.timedelta(days=days))], diligence.EVIDENCE).coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    assert {p for p, _ in ended} == {"p0"}


def test_evidence_from_packages(spark, tmp_path):
    body = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'>" + "x" * 3000 + "</w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "good.docx").write_bytes(data.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no archive" * 200)
    found = packages.packages(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "[^/]*$", 0))
    made = diligence.of_packages(found, packages.parts(found), F.lit(NOW)).unionByName(diligence.of_parts(packages.parts(found), "final_part", F.lit(NOW)))
    audited = diligence.audit(made)
    assert {(r["path"], r["step"]): r["severity"] for r in audited.collect() if r["step"] in ("apply", "package")} == {("good.docx", "apply"): "PASS", ("good.docx", "package"): "PASS", ("bad.docx", "apply"): "FAIL", ("bad.docx", "package"): "FAIL"}
    assert {tuple(r) for r in diligence.overall(audited).collect()} == {("good.docx", "WARN"), ("bad.docx", "FAIL")}
    assert {r["verdict"] for r in diligence.overall(audited, strict=True).collect()} == {"FAIL"}
