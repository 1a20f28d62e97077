"""Auxiliary parts and gates on small inputs."""

from pyspark.sql import functions as F

from paragrid.operators import auxiliary, gates


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


def test_numbering(spark):
    t = F.col("t")
    assert one(spark, auxiliary.translate_level(t, "hungarian"), "%1. sz. melléklet") == "Schedule %1"
    assert one(spark, auxiliary.translate_level(t, "german"), "Anlage %2") == "Schedule %2"
    assert one(spark, auxiliary.translate_level(t, "finnish"), "%1. luku") == "Chapter %1"
    assert one(spark, auxiliary.translate_level(t, "dutch"), "%1.") == "%1."
    assert one(spark, auxiliary.translate_level(t, "dutch", [("x%(\\d)", "Y %$1")]), "x%3") == "Y %3"
    levels = spark.createDataFrame([(1, "%1. hoofdstuk"), (1, "bijlage %1"), (2, "%1.")], "doc_id int, level string")
    assert {r["doc_id"]: r["language"] for r in auxiliary.numbering_language(levels).collect()} == {1: "dutch", 2: None}


def test_comments_and_terms(spark):
    comments = spark.createDataFrame([("p", "1", "uno"), ("p", "2", "due"), ("p", "3", "x")], "path string, id string, text string")
    translations = spark.createDataFrame([("p", "1", "one"), ("p", "2", " ")], "path string, id string, en string")
    got = {r["id"]: (r["en"], r["status"]) for r in auxiliary.translate_comments(comments, translations).collect()}
    assert got == {"1": ("one", "translated"), "2": ("due", "kept"), "3": ("x", "kept")}
    assert one(spark, auxiliary.replace_terms(F.col("t"), [("ab", "1"), ("abc", "2")]), "abc ab") == "2 1"


def test_fields(spark):
    runs = [(1, 0, "Page ", None, None), (1, 1, None, "begin", "PAGE"), (1, 2, "PAGE", None, None), (1, 3, None, "separate", None), (1, 4, "7", None, None), (1, 5, None, "end", None), (1, 6, " end", None, None)]
    r = auxiliary.field_text(spark.createDataFrame(runs, "doc_id int, idx int, text string, mark string, kind string"), "mark", "kind").first()
    assert r["text"] == "Page <<PAGE>> end" and r["fields"] == ["PAGE"]
    zones = lambda text, fields: spark.createDataFrame([(text, fields)], "t string, f array<string>").select(auxiliary.field_zones(F.col("t"), F.col("f")).alias("z")).first()["z"]
    assert zones("Seite <<PAGE>> Ende", ["PAGE"]) == ["Seite ", " Ende"]
    assert zones("none", ["PAGE"]) == ["none", ""] and zones("a<<PAGE>>b<<PAGE>>c", ["PAGE"]) == ["a", "bc"]


def test_distribution(spark):
    rows = spark.createDataFrame([(1, [" aaaa bbbb", "cc "], "one two three"), (2, ["a", "b"], None), (3, [], "x"), (4, ["", ""], "all")], "k int, pieces array<string>, en string")
    got = {r["k"]: r["parts"] for r in auxiliary.distribute(rows).collect()}
    assert got[2] == ["a", "b"] and got[3] == [] and "".join(got[1]).strip() == "one two three" and got[1][0].startswith(" one") and got[1][1].endswith(" ")
    assert auxiliary.cut_places([5, 5], "abcd efgh ij") == [0, 5, 12] and "".join(got[4]) == "all"


def test_people(spark):
    rows = [(1, 1, ["Office"]), (1, 1, ["A. Person"]), (12, 1, ["Office"]), (3, 3, [])]
    got = auxiliary.edited_by_people(spark.createDataFrame(rows, "n_ins int, n_del int, authors array<string>")).collect()
    assert [r["edited"] for r in got] == [False, True, True, False]


def test_gates(spark):
    read = spark.createDataFrame([(1,)], "doc_id int")
    found = spark.createDataFrame([("WARN",)], "severity string")
    assert gates.gate(read, found).first()["verdict"] == "WARN" and gates.gate(read, found.limit(0)).first()["verdict"] == "PASS"
    assert gates.gate(read.limit(0), found.limit(0)).first()["verdict"] == "VOID"
    all_ = gates.combined(spark.createDataFrame([("a", "PASS"), ("b", "VOID"), ("c", "BLOCK")], "name string, verdict string")).first()
    assert (all_["verdict"], all_["names"]) == ("VOID", ["b"])
    paragraphs = spark.createDataFrame([(1, k, "t", "e") for k in range(36)] + [(2, 0, "t", None)] + [(3, 0, "t", "e")], "doc_id int, idx int, text string, en string")
    log = spark.createDataFrame([], "doc_id int, idx int")
    assert {r["doc_id"]: r["verdict"] for r in gates.coverage_gate(paragraphs, log).collect()} == {1: "BLOCK", 2: "WARN", 3: "PASS"}
    assert {r["doc_id"]: r["verdict"] for r in gates.coverage_gate(paragraphs, paragraphs).collect()}[1] == "PASS"


def test_definition_gate(spark):
    texts = ["Definitions", "“Agent” means the one who acts", "“Buyer” means the one who buys", "“Clause” means a part of this", "“Deed” means this very deed"]
    runs = [(0, 5, True, False)]
    schema = "doc_id int, idx int, text string, en string, en_runs array<struct<start:int,end:int,bold:boolean,italic:boolean>>"
    bad = spark.createDataFrame([(1, k, t, None, None) for k, t in enumerate(texts)], schema)
    good = spark.createDataFrame([(1, k, t, None, runs) for k, t in enumerate(texts)], schema)
    assert gates.definition_gate(bad).count() == 4 and gates.definition_gate(good).count() == 0


def test_scans(spark):
    lines = spark.createDataFrame([("f", 1, "call 555-1234"), ("f", 2, "nothing")], "file string, line int, text string")
    got = gates.scan_lines(lines, spark.createDataFrame([(r"\d{3}-\d{4}",)], "pattern string")).collect()
    assert [(r["line"], len(r["match_hash"])) for r in got] == [(1, 12)]
    claims = spark.createDataFrame([("n", 1), ("n", 2), ("m", 1), ("m", 1)], "label string, value int")
    assert [(r["label"], r["values"]) for r in gates.consistent(claims).collect()] == [("n", [1, 2])]
    items = spark.createDataFrame([("one  thing",), ("lost",)], "item string")
    texts = spark.createDataFrame([("a", "here is One Thing"), ("b", "nothing")], "name string, text string")
    assert {r["item"]: r["places"] for r in gates.carried(items, texts).collect()} == {"one  thing": ["a"], "lost": []}
    assert one(spark, gates.expand_ids(F.col("t")), "A1–A3, B2") == ["A1", "A2", "A3", "B2"]
