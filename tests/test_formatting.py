"""Formatting operators on small inputs."""

from pyspark.sql import functions as F

from paragrid.operators import formatting, language

RUN = "struct<text:string,bold:boolean,italic:boolean>"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


def test_italics(spark):
    runs = [("these are four words", False, True), ("(Preservation of the Security)", False, True), ("it holds mutatis mutandis here", False, True), ("two words", False, True)]
    rows = spark.createDataFrame([(runs, None), (runs, True), (None, None)], f"runs array<{RUN}>, p_italic boolean")
    got = formatting.clear_italics(rows).collect()
    assert [r["cleared"] for r in got] == [1, 0, 0] and [r["italic"] for r in got[0]["runs"]] == [False, True, True, True]


def test_breaks_and_ranges(spark):
    styles = spark.createDataFrame([("Schedule 1 Terms", None), ("Schedule 1 Terms", "TOC 1"), ("the Schedule 1 says", None)], "t string, s string")
    assert [r["x"] for r in styles.select(formatting.wants_page_break(F.col("t"), F.col("s")).alias("x")).collect()] == [True, False, False]
    assert [tuple(r) for r in one(spark, formatting.bold_ranges(F.col("t")), "So “Deed” means it, “x” is not")] == [(3, 9)]
    heads = spark.createDataFrame([("One head", [("One", True, False), (" ", False, False), ("head", True, False)]), ("One head", [("One", True, False), ("head", False, False)])], f"t string, r array<{RUN}>")
    assert [r["x"] for r in heads.select(formatting.is_subheader(F.col("t"), F.col("r")).alias("x")).collect()] == [True, False]


def test_records(spark):
    kind = "array<struct<type:string,text:string>>"
    got = one(spark, formatting.skeleton(F.col("t")), [("regular", "a"), ("ins", "b"), ("del", "c"), ("ins", "d")], kind)
    assert [tuple(s) for s in got] == [("regular", None), ("ins", "<TRANSLATE>"), ("del", "<TRANSLATE>"), ("ins", "")]
    assert one(spark, formatting.split_with_zero_width(F.col("t")), "word to") == "wo​rd to"
    records = spark.createDataFrame([("d", 0, "one", None, [("ins", "two"), ("del", " ")]), ("d", 1, "", "gone", None)], "doc string, idx int, en string, en_deleted string, en_segments array<struct<type:string,en:string>>")
    assert sorted((r["idx"], r["field"], r["text"]) for r in formatting.target_entries(records).collect()) == [(0, "en", "one"), (0, "en_segments[0]", "two"), (1, "en_deleted", "gone")]
    parts = spark.createDataFrame([("p", "word/header1.xml", 0, "a"), ("p", "word/footer1.xml", 1, "b"), ("p", "word/footer1.xml", 3, "c"), ("p", "word/document.xml", 0, "x"), ("p", "word/header1.xml", 1, " ")], "path string, part string, idx int, text string")
    assert sorted((r["idx"], r["source"], r["p_idx"]) for r in formatting.scaffold(parts).collect()) == [(0, "word/footer1.xml", 0), (1, "word/footer1.xml", 1), (2, "word/header1.xml", 0)]
    pairs = spark.createDataFrame([(["colour / honour", "color / honor"],), (["same", "same"],), (["lone"],)], "cells array<string>")
    assert sorted((r["uk"], r["us"]) for r in formatting.variant_pairs(pairs).collect()) == [("colour", "color"), ("honour", "honor")]


def test_guess(spark):
    texts = [("契約です", "japanese"), ("协议各方", "chinese"), ("żółć łąka śnieg", "polish"), ("plain", "*"), ("und der die das mit", "german")]
    got = spark.createDataFrame(texts, "t string, want string").select(language.guess(F.col("t")).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]
