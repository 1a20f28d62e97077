"""Operators on small invented inputs: each check has an input that it must reject and one that it must accept."""

import random
import zipfile

from pyspark.sql import functions as F

from paragrid.functions import rules, text
from paragrid.operators import audit, definitions, findings, language, matching, normalize, quality, revisions, sequence, state
from paragrid.sources import packages
from paragrid.sources.text import glossary, markdown_rows, table_faults
from paragrid.streaming import coverage


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(column.alias("x")).first()["x"]


def lines(spark, *texts):
    return spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, idx int, text string")


def test_scalar_functions(spark):
    t = F.col("t")
    assert one(spark, text.normalized(t), "  a \n b ") == "a b"
    assert one(spark, text.tokens(t), "Seller.Buyer pays the clause 'Fee'") == ["seller", "buyer", "pays", "the", "fee"]
    assert [one(spark, text.is_noise(t), x) for x in (" - ", "5 %", None)] == [True, False, True]
    assert one(spark, text.orthographic_key(t), " Zero​Width  x") == "zerowidth x"
    assert [one(spark, text.tri_state(t), x) for x in (None, "0", "OFF", "true", "1")] == [None, False, False, True, True]
    assert one(spark, text.defined_term(t), "“Seller” means the party that sells") == "Seller"
    assert one(spark, text.defined_term(t), "Nothing quoted here") is None
    assert one(spark, text.quoted_phrases(t), "a “one two three four five” b ‘one two’ “short”") == ["one two three four five", "one two"]
    assert one(spark, text.sentences(t), "A b. C d!\n\nE") == ["A b.", "C d!", "E"]


def test_missing_space(spark):
    pairs = [("word", "Next", True), ("end.", "Next", True), ("Mr.", "Smith", False), ("word ", "next", False), ("5", "Days", True), ("a;", "b", True), ("x", "(y)", True)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select(text.needs_space(F.col("a"), F.col("b")).alias("x"), "want").collect()
    assert [r["x"] for r in got] == [r["want"] for r in got]
    assert [r["text"] for r in normalize.fix_spacing(lines(spark, "one", "Two", " three")).orderBy("idx").collect()] == ["one", " Two", " three"]


def test_views_and_folds(spark):
    kind = "array<struct<type:string,en:string>>"
    s = F.col("t")
    notice = [("regular", "Notice goes to "), ("del", "the"), ("ins", "each office of"), ("regular", " the Seller.")]
    assert one(spark, revisions.view(s, "accept"), notice, kind) == "Notice goes to each office of the Seller."
    assert one(spark, revisions.view(s, "reject"), notice, kind) == "Notice goes to the the Seller."
    docs = spark.createDataFrame([(0, notice), (1, [("regular", "to "), ("del", "one office"), ("ins", "two offices"), ("regular", " of it.")])], f"doc_id int, segments {kind}")
    assert sorted(tuple(r) for r in revisions.view_findings(docs).collect()) == [(0, "reject", "double_article", 1), (0, "reject", "repeated_word", 1)]
    kind = "array<struct<type:string,text:string>>"
    pairs = [("ins", "a  b"), ("del", "a b"), ("del", " - "), ("regular", "x"), ("ins_then_del", "gone"), ("ins", "new")]
    assert [tuple(x) for x in one(spark, revisions.strip_noops(s), pairs, kind)] == [("regular", "a  b"), ("regular", "x"), ("ins", "new")]
    assert [tuple(x) for x in one(spark, revisions.merged(s), [("ins", "a"), ("ins", None), ("del", "c"), ("ins", "d")], kind)] == [("ins", "a"), ("del", "c"), ("ins", "d")]
    assert one(spark, revisions.merged(s), [], kind) == []


def test_segment_rules(spark):
    rows = spark.createDataFrame([(1, 0, "regular", "Send to the"), (1, 1, "ins", "the office"), (2, 0, "ins", "the"), (3, 0, "ins", "all outstanding"), (4, 0, "regular", "word"), (4, 1, "del", "glued"), (5, 0, "regular", "in 5"), (5, 1, "ins", "days")], "doc_id int, idx int, type string, text string")
    got = {(r["doc_id"], r["rule"]) for r in revisions.segment_findings(rows).collect()}
    assert got == {(1, "article_collision"), (1, "alpha_collision"), (2, "bare_article"), (4, "alpha_collision"), (5, "digit_at_boundary")}


def test_fragment_clusters(spark):
    rows = spark.createDataFrame([(1, 0, "regular", "The "), (1, 1, "ins", "ca"), (1, 2, "del", "do"), (1, 3, "ins", "t"), (1, 4, "del", "g"), (1, 5, "regular", " runs far")], "doc_id int, idx int, type string, text string")
    r = revisions.fragment_clusters(rows).first()
    assert (r["n"], r["inserted"], r["deleted"]) == (4, "cat", "dog")


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", None), (1, 2, None, "y"), (1, 3, None, "z"), (1, 4, "a", "w")], "doc_id int, idx int, kind string, text string")
    assert [(r["kind"], r["first"], r["last"], r["text"]) for r in sequence.islands(rows, "kind").orderBy("island").collect()] == [("a", 0, 1, "x"), (None, 2, 3, "yz"), ("a", 4, 4, "w")]
    assert [r["group"] for r in sequence.running_group(rows, F.col("kind") == "a").orderBy("idx").collect()] == [1, 2, 2, 2, 3]
    marks = spark.createDataFrame([(1, k, m) for k, m in enumerate(["t", "begin", "i", "separate", "r", "end", "t"])], "doc_id int, idx int, mark string")
    regions = sequence.field_regions(marks, "mark").orderBy("idx").collect()
    assert [r["region"] for r in regions] == ["outside", "instruction", "instruction", "result", "result", "outside", "outside"] and [r["zone"] for r in regions][-1] == 1
    levels = spark.createDataFrame([(1, 0, 0, "n"), (1, 1, 2, "n"), (1, 2, 3, "n"), (1, 3, 2, "m")], "doc_id int, idx int, ilvl int, num string")
    assert sorted(r["idx"] for r in sequence.level_jumps(levels, "ilvl", "num").collect()) == [1, 3]


def test_language(spark):
    docs = spark.createDataFrame([(1, "Der Vertrag und die Parteien mit dem Recht"), (2, "xyz"), (3, "契約の当事者は本契約に")], "doc_id int, text string")
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", language.detect(F.col("text")).alias("x")).collect()}
    assert got == {1: "german", 2: None, 3: "japanese"}
    rest = spark.createDataFrame([(1, "the gemäß rule", "german"), (2, "clean", "german"), (3, "anything", "klingon"), (4, "Banca d'Italia", "italian")], "doc_id int, text string, of string")
    found = [(r["doc_id"], r["marker"]) for r in language.remnants(rest, F.col("of")).orderBy("doc_id").collect()]
    assert found == [(1, "gemäß"), (3, None)]  # an unknown language isn't clean but unchecked


def test_normalisation(spark):
    rows = spark.createDataFrame([(1, "The the rights existing and future,, of Annex 2:: authorize Article 5 of this deed"), (2, "Annex 1 of the Directive. Article 3 of the Penal Act"), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in normalize.apply_passes(rows).collect()}
    assert got[1]["text"] == "The existing and future rights, of Schedule 2: authorise Clause 5 of this deed"
    assert got[1]["changed"] == ["double_punctuation", "terminology", "spelling", "annexes", "internal_articles", "doubled_words"]
    assert got[2]["text"] == "Annex 1 of the Directive. Article 3 of the Penal Act" and got[2]["changed"] == [] and got[3]["text"] is None


def test_matching(spark):
    left, right = lines(spark, "a", "b", "a", "c"), lines(spark, "b", "a", "x", "x", "a")
    got = sorted((r["idx"], r["match_idx"], r["match_kind"]) for r in matching.nearest_exact(left, right).collect())
    assert got == [(0, 1, "nearest"), (1, 0, "exact"), (2, 4, "nearest")]
    a, b = lines(spark, "alpha beta gamma delta", "alpha beta"), lines(spark, "beta alpha", "delta gamma beta alpha")
    assert sorted((r["idx"], r["match_idx"]) for r in matching.greedy_overlap(a, b).collect()) == [(0, 1), (1, 0)]
    missing = matching.missing_tokens(a, b).collect()
    assert [(r["idx"], sorted(r["missing"])) for r in missing] == [(0, ["delta", "gamma"])]


def test_prefixes(spark):
    left = lines(spark, "a short entry", "x", "this text is longer than thirty characters A", "a short entry")
    right = lines(spark, "a short entry and its rest", "other", "this text is longer than thirty characters B", "a short entry, cut", "a short")
    pairs = matching.prefix_candidates(left, right).select(F.col("a.idx").alias("i"), F.col("b.idx").alias("j")).collect()
    assert sorted(map(tuple, pairs)) == [(0, 0), (0, 3), (2, 2), (3, 0), (3, 3)]
    none = matching.nearest_exact(left, right)
    assert none.count() == 0
    got = sorted((r["idx"], r["match_idx"], r["match_kind"]) for r in matching.nearest_by_prefix(left, right, none).collect())
    assert got == [(0, 0, "prefix"), (2, 2, "prefix"), (3, 3, "prefix")]
    taken = spark.createDataFrame([(1, 0, 0, "exact")], "doc_id long, idx long, match_idx long, match_kind string")
    assert sorted((r["idx"], r["match_idx"]) for r in matching.nearest_by_prefix(left, right, taken).collect()) == [(2, 2), (3, 3)]


def greedy(left, right, share=0.5):
    """Brute force: (left row, right row) of token sets, each a list by place."""
    matched, used = {}, set()
    for i in sorted((i for i in range(len(left)) if left[i]), key=lambda i: (-len(left[i]), i)):
        free = [j for j in range(len(right)) if j not in used]
        best = max(free, key=lambda j: (len(left[i] & right[j]), -j), default=None)
        if best is not None and len(left[i] & right[best]) >= share * len(left[i]):
            matched[i] = best
            used.add(best)
    for place, i in enumerate(i for i in range(len(left)) if left[i]):
        if i not in matched and place < len(right) and place not in used:
            matched[i] = place
            used.add(place)
    return matched


def test_greedy_against_brute_force(spark):
    r = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    sides = [[[" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 7))] for _ in range(40)] for _ in range(2)]
    frames = [spark.createDataFrame([(d, k, t) for d, texts in enumerate(side) for k, t in enumerate(texts)], "doc_id long, idx int, text string") for side in sides]
    got = {}
    for x in matching.greedy_overlap(*frames).collect():
        got.setdefault(x["doc_id"], {})[x["idx"]] = x["match_idx"]
    assert got == {d: want for d in range(40) if (want := greedy(*[[set(t.split()) for t in side[d]] for side in sides]))}


def test_definitions_of_two_clusters(spark):
    """Only the first cluster is a block; the last definition keeps its further rows; new places are a permutation."""
    first = ["Definitions", "“Zeta” means the last letter", "“Beta” means the second letter", "“Alpha” means the first letter", "(a) with this", "(b) and that", "OTHER MATTERS"]
    rows = lines(spark, *first, *[f"Text {k}" for k in range(25)], "“Y” means another thing", "“X” means one more thing", "“W” means some thing")
    found = definitions.sections(rows)
    assert [(r["first"], r["last"]) for r in found.collect()] == [(1, 5)]
    new = {r["idx"]: r["new_idx"] for r in definitions.reordered(rows, found).collect()}
    assert sorted(new.values()) == list(range(35)) and all(new[k] == k for k in [0, *range(6, 35)])
    assert [new[k] for k in range(1, 6)] == [5, 4, 1, 2, 3]


def test_passes_that_must_and_must_not_change(spark):
    t = F.col("t")
    cases = [
        (normalize.annexes, "See ANNEX 1, Annex 2 and Annexes 3", "See SCHEDULE 1, Schedule 2 and Schedules 3"),
        (normalize.annexes, "ANNEX 1 of the Directive", "ANNEX 1 of the Directive"),
        (normalize.internal_articles, "Articles 5 and 6 of this deed", "Clauses 5 and 6 of this deed"),
        (normalize.internal_articles, "Articles 5 and 6 of the Penal Act", "Articles 5 and 6 of the Penal Act"),
        (normalize.internal_articles, "Article 12-bis of the Penal Act", "Article 12-bis of the Penal Act"),
        (normalize.internal_articles, "Article 12-bis.", "Clause 12-bis."),
        (normalize.definition_line_breaks, "It means\nnothing.", "It means\nnothing."),
        (normalize.definition_line_breaks, "“It”\nmeans nothing.", "“It” means nothing."),
    ]
    for step, before, after in cases:
        assert one(spark, step(t), before) == after
    pieces = lines(spark, "by the Seller,", "  ", "“x” seller's", "Seller pays", "and and", "to", "to all")
    assert [r["text"] for r in normalize.drop_doubled_across(lines(spark, "of the Seller,", "  ", "(Seller pays", "all", "All", "up to", "to go")).orderBy("idx").collect()] == ["of the Seller,", "  ", " pays", "all", " ", "up to", "to go"]
    assert normalize.drop_doubled_across(pieces).count() == 7


def test_brackets_and_hyphens(spark):
    kind, s = "array<struct<type:string,text:string>>", F.col("t")
    near = [("ins", "["), *[("regular", f"r{k}") for k in range(6)], ("ins", "12 May")]
    far = [("ins", "["), *[("regular", f"r{k}") for k in range(8)], ("ins", "12 May")]
    assert len(one(spark, revisions.strip_noops(s), near, kind)) == len(near) and len(one(spark, revisions.strip_noops(s), far, kind)) == len(far) - 1
    only_sign = [("del", "("), ("ins", "%")]
    assert [x["text"] for x in one(spark, revisions.strip_noops(s), only_sign, kind)] == ["%"]
    rows = spark.createDataFrame([(1, 0, "regular", "pre-tax"), (1, 1, "ins", "rate"), (2, 0, "regular", "pre-"), (2, 1, "ins", "tax")], "doc_id int, idx int, type string, text string")
    assert [(r["doc_id"], r["rule"]) for r in revisions.segment_findings(rows).collect()] == [(1, "alpha_collision")]


def test_chained_trees(spark):
    rows = spark.createDataFrame([(0, "a", 1), (0, "b", 1), (1, "a", 2), (2, "a", 2), (2, "c", 1)], "place int, key string, v int")
    got = sorted(map(tuple, audit.parity(*audit.chained(rows, "place"), ["pair", "key"], "v").collect()))
    assert got == [(0, "a", "differs"), (0, "b", "left_only"), (1, "a", "same"), (1, "c", "right_only")]


def test_definitions(spark):
    rows = lines(spark, "Definitions", "“Buyer” means the one who buys", "and its heirs", "“agent” means the one who acts", "“Clause” means a part of this", "“Zone” means the zone of trade", "Other text")
    found = definitions.sections(rows)
    assert [(r["first"], r["last"], r["n"]) for r in found.collect()] == [(1, 6, 4)]  # no heading ends it before the document does
    new = {r["idx"]: r["new_idx"] for r in definitions.reordered(rows, found).collect()}
    assert new == {0: 0, 3: 1, 1: 2, 2: 3, 4: 4, 5: 5, 6: 6} and sorted(new.values()) == sorted(new)


def test_quality(spark):
    bad = lines(spark, "This Financing Agreement is is stipulated under Article 5,, and signed by the")
    checks = {r["check"] for r in quality.check_paragraphs(bad).collect()}
    assert {"terminology", "doubled_word", "double_punctuation", "article_reference", "truncation", "standalone_financing"} <= checks
    assert quality.check_paragraphs(lines(spark, "The Seller delivers the goods to the Buyer in time.")).count() == 0
    pairs = spark.createDataFrame([("x" * 200, "y" * 50), ("x" * 200, "y" * 100), ("x" * 200, "y" * 150), ("abc", None), ("", None)], "text string, en string")
    assert [r["band"] for r in quality.length_ratio(pairs).collect()] == ["block", "warn", "ok", "missing", "ok"]
    found = findings.findings(bad, quality.checks(F.col("text")), ["doc_id", "idx"])
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    rollup = {r["doc_id"]: r["severity"] for r in findings.severity_rollup(found, docs).collect()}
    assert rollup == {1: "BLOCK", 2: "PASS"}


def test_phrase_rules(spark):
    entries = spark.createDataFrame([(1, "in the present Agreement", "dutch"), (2, "the Wind Park", "italian"), (3, "the Wind Park", "dutch"), (4, "the Wind Park", "*")], "doc_id int, text string, of string")
    got = findings.rule_join(entries, rules.phrase_rules(spark), language=F.col("of"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]


def test_state(spark):
    log = spark.createDataFrame([(1, k, "b1", False) for k in range(36)] + [(2, k, "b1", False) for k in range(35)] + [(3, k, "b1", True) for k in range(40)], "doc_id int, idx int, batch string, override boolean")
    assert [r["doc_id"] for r in state.batches_over_cap(log, override=F.col("override")).collect()] == [1]
    items = spark.createDataFrame([(1, "a"), (2, "b")], "k int, content string")
    evidence = items.where("k = 1").select("k", F.sha2("content", 256).alias("sha256"), F.lit(False).alias("not_applicable"))
    assert {r["k"]: r["status"] for r in state.freshness(items, evidence, "k", "content").collect()} == {1: "fresh", 2: "missing"}
    assert audit.unresolved(spark.createDataFrame([("Payment Terms",), ("Other",)], "cited string"), spark.createDataFrame([("payment terms and more",)], "heading string")).collect()[0]["cited"] == "Other"


def document(body):
    return f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'


def test_packages(spark, tmp_path):
    run = lambda t, p="": f"<w:r>{p}<w:t>{t}</w:t></w:r>"
    bold = "<w:rPr><w:b/></w:rPr>"
    off = '<w:rPr><w:b w:val="off"/></w:rPr>'
    body = f'<w:p><w:pPr><w:rPr><w:b/></w:rPr></w:pPr>{run("A", bold)}{run("b", off)}{run("c")}</w:p><w:tbl><w:tr><w:tc><w:p>{run("x")}<w:ins w:author="P">{run("new")}<w:del><w:r><w:delText>both</w:delText></w:r></w:del></w:ins><w:del w:author="Q"><w:r><w:delText>old</w:delText></w:r></w:del></w:p></w:tc></w:tr></w:tbl><w:p/>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", document(body))
        z.writestr("word/comments.xml", '<w:comments><w:comment w:id="7"><w:t>one</w:t><w:t> two</w:t></w:comment></w:comments>')
    (tmp_path / "b.docx").write_text("no archive")
    (tmp_path / "c.docx").write_bytes((tmp_path / "a.docx").read_bytes()[:200])
    parts = packages.parts(packages.packages(spark, str(tmp_path)))
    assert sorted(r["path"][-6:] for r in parts.where("error is not null").collect()) == ["b.docx", "c.docx"]
    first, second = packages.paragraphs(parts).orderBy("idx").collect()
    assert first["text"] == "Abc" and [r["bold"] for r in first["runs"]] == [True, False, True] and not first["has_track_changes"]
    assert [(s["type"], s["text"]) for s in second["tc_segments"]] == [("regular", "x"), ("ins", "new"), ("ins_then_del", "both"), ("del", "old")] and second["text"] == "xnew"
    counts = packages.revision_counts(parts).where("part like '%document.xml'").first()
    assert (counts["n_ins"], counts["n_del"], counts["authors"]) == (1, 2, ["P", "Q"])
    assert [(r["id"], r["text"]) for r in packages.comments(parts).collect()] == [("7", "one two")]
    clean = parts.where("part = 'word/document.xml'").select("path", "part", packages.accept_revisions(F.col("content").cast("string")).cast("binary").alias("content"))
    packed = packages.repack(parts, clean).collect()
    assert len(packed) == 1 and packed[0]["error"] is None
    again = packages.paragraphs(packages.parts(spark.createDataFrame([(packed[0]["path"], packed[0]["content"])], "path string, content binary"))).orderBy("idx").collect()
    assert [r["text"] for r in again] == ["Abc", "xnew"] and not again[1]["has_track_changes"]


def test_markdown(spark, tmp_path):
    (tmp_path / "g.md").write_text("# G\n\n| term | use |\n|---|---|\n| a \\| b | c |\n\n| x | y |\n| 1 | 2 |\n\n| p | q |\n|---|---|\n| 1 | 2 | 3 |\n")
    path = str(tmp_path / "g.md")
    assert markdown_rows(spark, path).where("line = 5").first()["cells"] == ["a | b", "c"]
    assert glossary(spark, path).count() == 6
    assert sorted((r["line"], r["fault"]) for r in table_faults(spark, path).collect()) == [(8, "no delimiter"), (12, "width")]


def test_stream(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for k, n in enumerate((3, 40)):
        spark.range(n).select(F.lit(k).cast("long").alias("doc_id"), F.col("id").alias("idx")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, idx long").parquet(source)
        coverage.follow(stream, log, str(tmp_path / "cp")).awaitTermination()
    coverage.append_new(spark.read.parquet(source), 9, log)
    got = spark.read.parquet(log)
    assert got.count() == 43 and {r["doc_id"] for r in got.where("over_cap").collect()} == {1} and got.where("batch = 9").count() == 0


def test_places_left_are_those_not_yet_covered(spark):
    docs = spark.createDataFrame([(1,), (2,), (None,)], "doc_id int")
    log = spark.createDataFrame([(1, 0), (1, 0), (1, 7), (2, 1), (3, 2)], "doc_id int, idx long")
    places = F.array(*[F.lit(k).cast("long") for k in range(3)])
    found = state.places_left(docs, places, log)
    assert sorted(found.collect(), key=str) == sorted(state.not_yet(docs.select("doc_id", F.explode(places).alias("idx")), log).collect(), key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # what is exploded doesn't travel


def test_rules_are_fixed_patterns_and_find_what_rows_find(spark):
    rules = spark.createDataFrame([(0, r"(?iU)\bwind park\b", "*"), (1, r"(?iU)\bnet\b", "dutch"), (2, r"(?iU)\bwind park\b", "german"), (3, None, "*"), (4, r"^\s*[A-Z]:", "*")], "seq int, pattern string, language string")
    rows = spark.createDataFrame([(1, "the Wınd Park"), (2, "a net, a wind  park"), (3, "X: Net"), (4, None)], "k int, text string")
    for language in (None, F.lit("dutch")):
        fixed, read = (findings.rule_join(rows, rules, language=language, most_fixed=n) for n in (400, 0))
        assert sorted(fixed.collect()) == sorted(read.collect()) and fixed.columns == read.columns
    assert "NestedLoop" not in findings.rule_join(rows, rules)._jdf.queryExecution().executedPlan().toString()


def test_overlap_finds_the_tokens_of_the_right_side_once(spark):
    left = spark.createDataFrame([(1, "alpha beta gamma"), (2, "Delta's-'"), (3, None)], "a int, text string")
    right = spark.createDataFrame([(7, "Alpha.Beta and gamma"), (8, "delta's x"), (9, None), (10, "alpha")], "b int, text string")
    found = matching.overlap_candidates(left, right, "a", "b", share=0.5)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 3, 3), (2, 8, 1, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2  # of the left side alone


def test_blanks_of_all_kinds_are_made_one_and_go_at_the_ends(spark):
    r = random.Random(3)
    rows = [("".join(r.choice(" \t\n  \u0085 \rab") for _ in range(r.randint(0, 8))),) for _ in range(2000)] + [(None,)]
    plain = F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), "^ | $", ""), F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    made = spark.createDataFrame(rows, "t string").select(*plain, text.normalized(F.col("t")), text.trimmed(F.col("t"))).collect()
    assert all(x[0] == x[2] and x[1] == x[3] for x in made)
