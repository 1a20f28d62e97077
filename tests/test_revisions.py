"""Folding, noise, absorption and clusters of revisions against the rules followed step by step, on columns and on parts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from paragrid.functions.rules import TRANSPARENT_MARKS
from paragrid.operators import noops, revisions
from paragrid.sources import packages

KIND = "array<struct<type:string,text:string>>"
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def plain(t):
    return re.sub(r"\s+", " ", t or "").strip()


def pairs(rows):
    rows = list(rows)
    while True:
        for i, (kind, text) in enumerate(rows):
            j = i + 1
            while j < len(rows) and rows[j][0] in TRANSPARENT_MARKS:
                j += 1
            if kind in ("ins", "del") and j < len(rows) and {kind, rows[j][0]} == {"ins", "del"} and plain(text) == plain(rows[j][1]):
                ins, gone = (i, j) if kind == "ins" else (j, i)
                kept = [("regular", rows[ins][1])] if rows[ins][1] else []
                rows[ins : ins + 1] = kept
                del rows[gone + (len(kept) - 1 if gone > ins else 0)]
                break
        else:
            return rows


def noise(rows):
    rows, i = list(rows), 0
    content = lambda r: r[0] in ("ins", "del", "ins_then_del") and any(c.isalnum() for c in r[1] or "")
    while i < len(rows):
        kind, text = rows[i]
        if kind in ("ins", "del", "ins_then_del") and not any(c.isalnum() or c in "%&$€£¥" for c in text or ""):
            bracket = plain(text) and all(c in "[](){}" for c in plain(text))
            if not (bracket and any(map(content, rows[max(0, i - 8) : i] + rows[i + 1 : i + 9]))):
                del rows[i]
                continue
        i += 1
    return rows


def by_the_rules(rows):
    return [r for r in pairs(noise(pairs(rows))) if r[0] != "ins_then_del"]


def random_rows(r):
    kinds = ["regular", "ins", "del", "ins", "del", "bookmarkStart", "proofErr", "ins_then_del"]
    out = []
    for _ in range(r.randint(0, 14)):
        kind = r.choice(kinds)
        out.append((kind, "" if kind in TRANSPARENT_MARKS else r.choice(["a", "a ", "b", "[", "]", ",", "", " ", "%"])))
    return [(k, t or "r") if k == "regular" else (k, t) for k, t in out]


def applied(spark, f, many):
    made = spark.createDataFrame([(k, x) for k, x in enumerate(many)], f"k int, s {KIND}").select("k", f(F.col("s")).alias("x"))
    return [None if x is None else [tuple(r) for r in x] for _, x in sorted((r["k"], r["x"]) for r in made.collect())]


@pytest.fixture(scope="module")
def many():
    r = random.Random(5)
    return [random_rows(r) for _ in range(400)]


def test_columns_follow_the_rules(spark, many):
    assert applied(spark, revisions.fold_pairs, many) == [pairs(x) for x in many]
    assert applied(spark, revisions.drop_noise, many) == [noise(x) for x in many]
    assert applied(spark, revisions.strip_noops, many) == [by_the_rules(x) for x in many]


def test_marks_do_not_part_a_pair_and_content_does(spark):
    parted = [("del", "x"), ("bookmarkStart", ""), ("bookmarkEnd", ""), ("ins", "x")], [("del", "x"), ("regular", "r"), ("ins", "x")]
    assert applied(spark, revisions.fold_pairs, parted) == [[("bookmarkStart", ""), ("bookmarkEnd", ""), ("regular", "x")], list(parted[1])]


def markup_of(rows):
    def one(kind, text):
        run = lambda tag: f'<w:r><w:{tag} xml:space="preserve">{text}</w:{tag}></w:r>' if text else ""
        return {"regular": run("t"), "ins": f"<w:ins>{run('t')}</w:ins>", "del": f"<w:del>{run('delText')}</w:del>", "ins_then_del": f"<w:ins><w:del>{run('delText')}</w:del></w:ins>"}.get(kind, f"<w:{kind}/>")

    return "".join(one(*r) for r in rows)


def test_parts_follow_the_rules(spark, many):
    usable = [[r for r in x if r[0] != "ins_then_del"] for x in many[:150]]
    parts = spark.createDataFrame([(str(k), "d", bytearray(f"<w:p {W}>{markup_of(x)}</w:p>".encode()), None) for k, x in enumerate(usable)], "path string, part string, content binary, error string")
    made = {r["path"]: r for r in noops.strip_parts(parts).collect()}
    for k, x in enumerate(usable):
        want = f"<w:p {W}>{markup_of(by_the_rules(x))}</w:p>"
        assert (bytes(made[str(k)]["content"]).decode() if str(k) in made else f"<w:p {W}>{markup_of(x)}</w:p>") == want


def test_phantoms_and_counts(spark):
    xml = f'<w:p {W}><w:pPr/><w:ins w:id="1"><w:del><w:r><w:delText>p</w:delText></w:r></w:del></w:ins><w:ins><w:r><w:t>a</w:t></w:r></w:ins><w:proofErr/><w:del><w:r><w:delText> a</w:delText></w:r></w:del><w:del><w:r><w:delText>,</w:delText></w:r></w:del></w:p>'
    parts = spark.createDataFrame([("p", "d", bytearray(xml.encode()), None), ("q", "d", bytearray(b"<bad"), None)], "path string, part string, content binary, error string")
    (got,) = noops.strip_parts(parts).collect()
    assert (got["pair"], got["noise"], got["phantom"], got["error"]) == (1, 1, 1, None)
    assert bytes(got["content"]).decode() == f"<w:p {W}><w:pPr/><w:r><w:t>a</w:t></w:r><w:proofErr/></w:p>"
    assert noops.strip_parts(parts, keep_phantoms=True).first()["phantom"] == 0
    assert packages.paragraph_rows(bytes(got["content"]))[0][1] == "a"


def test_blanks_are_absorbed(spark):
    rows = [[("ins", " "), ("del", "\t"), ("regular", "a"), ("ins", " "), ("ins", "x"), ("del", "  "), ("regular", "b"), ("ins", "​ "), ("del", "")], [("ins", " "), ("del", "x")], []]
    assert applied(spark, revisions.absorb_blanks, rows) == [[("regular", "\t a   "), ("ins", "x"), ("regular", "b"), ("ins", "​ "), ("del", "")], [("ins", " "), ("del", "x")], []]


def test_clusters(spark):
    rows = [[("regular", "The "), ("ins", "ca"), ("del", "do"), ("regular", "x"), ("ins", "t"), ("del", "g"), ("regular", " runs")], [("ins", "a"), ("del", "b"), ("regular", " c"), ("ins", "q"), ("del", "w"), ("del", "e")], [("ins", "a" * 61), ("del", "b"), ("del", "c")], []]
    assert applied(spark, revisions.clusters, rows) == [[(1, 5, "caxt", "doxg")], [(3, 5, "q", "we")], [], []]
    assert applied(spark, revisions.coalesced, rows) == [[("regular", "The "), ("ins", "caxt"), ("del", "doxg"), ("regular", " runs")], [("ins", "a"), ("del", "b"), ("regular", " c"), ("ins", "q"), ("del", "we")], rows[2], []]
    asked = applied(spark, revisions.cluster_skeleton, rows)
    assert asked[0] == [("regular", ""), ("ins", "<<TRANSLATE: ins='caxt' (accepted)>>"), ("del", "<<TRANSLATE: del='doxg' (rejected)>>"), ("regular", ""), ("ins", ""), ("del", ""), ("regular", "")] and asked[2] is None
    direct = applied(spark, lambda s: revisions.cluster_skeleton(s, inserted="new", deleted="old"), rows)
    assert [t for _, t in direct[1]] == ["", "", "", "new", "old", ""]


def test_guards(spark):
    rows = spark.createDataFrame([(1, [("ins", "word"), ("ins", "a b"), ("del", "xy")], [("ins", 2)]), (2, [("ins", "w")], None), (3, None, [("ins", 2)])], "k int, en_segments array<struct<type:string,en:string>>, tc_cluster_hits array<struct<type:string,count:int>>")
    got = {r["k"]: ([s["en"] for s in r["en_segments"]] if r["en_segments"] else None, r["changed"]) for r in revisions.guard_clusters(rows).collect()}
    assert got == {1: (["w​o​r​d", "a b", "xy"], 1), 2: (["w"], 0), 3: (None, 0)}
    assert applied(spark, revisions.same_kind_runs, [[("ins", "a"), ("ins", "b"), ("del", "c"), ("regular", "d"), ("regular", "e")], []]) == [[("ins", 2)], []]
