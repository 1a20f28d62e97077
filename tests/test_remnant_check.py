"""The remnant check: the automaton against patterns tried one by one, floors, density, views, filters, auxiliary parts."""

from __future__ import annotations

import random
import re

import pytest

from paragrid.functions.rules import ALLOWED_CONTEXTS, REMNANT_MARKERS, SUBSTRING_LANGUAGES
from paragrid.operators import remnant_check as rc

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def one_by_one(text, lang):
    out = []
    for k, p in enumerate(dict(REMNANT_MARKERS)[lang]):
        for m in re.finditer(p if lang in SUBSTRING_LANGUAGES else rf"\b{p}\b", text, 0 if lang in SUBSTRING_LANGUAGES else re.IGNORECASE):
            around = text[max(0, m.start() - 30) : m.end() + 30]
            if not any(a in around for a in ALLOWED_CONTEXTS):
                out.append((m.start(), k, around))
    return sorted(out)


@pytest.mark.parametrize("lang", [lang for lang, _ in REMNANT_MARKERS])
def test_automaton_equals_patterns(lang):
    r = random.Random(lang)
    some = ["GEMÄSS", "Vertragsparteien", "vertragsparteiisch", "surséance", "surseance", "artikel 12", "artikel", "ivi inclusi", "divi inclusi", "Reiwa 5", "Reiwa Corp", "heisei  29", "İstanbul", "delle", "modelle", "Banca d'Italia", "conforme a", "Administradores"]
    words = some + [re.sub(r"\\[a-z]\*|\[.*?\]\+?", "", w) for w in dict(REMNANT_MARKERS)[lang]] + ["x", ",", "the"]
    for _ in range(200):
        text = "".join(r.choice(words) + r.choice([" ", " ", "", ", ", "-"]) for _ in range(r.randint(0, 12)))
        assert rc.hits(text, tuple(dict(REMNANT_MARKERS)[lang]), lang in SUBSTRING_LANGUAGES, tuple(ALLOWED_CONTEXTS)) == one_by_one(text, lang)


def scanned(spark, *rows):
    made = spark.createDataFrame([(k, 0, *r) for k, r in enumerate(rows)], "doc_id int, idx int, language string, text string, deleted_text string")
    return {(r["doc_id"], r["view"], r["kind"], r["marker"]) for r in rc.scan(made).collect()}


def test_floors_views_and_density(spark):
    found = scanned(spark, ("german", "gemäß Rahmen", None), ("German", "so gemäß dem", None), ("german", "x y z", "sofern"), ("german", "gemäß sofern mithin", None), ("german", None, " "), ("klingon", "gemäß so x", None), (None, "gemäß so x", "sofern"))
    assert found == {(1, "accept", "remnant", "gemäß"), (2, "reject", "remnant", "sofern"), (3, "accept", "remnant", "gemäß"), (3, "accept", "remnant", "sofern"), (3, "accept", "remnant", "mithin"), (3, "accept", "dense", None)}


def test_italian_surroundings_and_allowed_phrases(spark):
    found = scanned(spark, ("italian", "the delle come that", None), ("italian", "non-delle x y", None), ("italian", "per cent delle x", None), ("italian", "a della Banca d'Italia b", None), ("italian", "one qualora two", None), ("italian", "come delle, della, alla", None))
    assert found == {(4, "accept", "remnant", "qualora"), (5, "accept", "dense", None)}


def test_auxiliary_parts(spark):
    parts = {"word/numbering.xml": f'<w:numbering {W}><w:lvlText w:val="%1 artikel 3"/><w:lvlText w:val=" "/></w:numbering>', "word/footnotes.xml": f"<w:footnotes {W}><w:t>delle</w:t><w:t>Partijen</w:t></w:footnotes>", "word/header2.xml": "<broken", "word/document.xml": f"<w:p {W}><w:t>Partijen</w:t></w:p>"}
    rows = spark.createDataFrame([("p", n, bytearray(x.encode()), None) for n, x in parts.items()] + [("q", "word/comments.xml", bytearray(f"<w:c {W}><w:t>come delle</w:t></w:c>".encode()), None)], "path string, part string, content binary, error string")
    languages = spark.createDataFrame([("p", "Dutch"), ("q", "italian")], "path string, language string")
    found = {(r["path"], r["part"], r["idx"], r["element"], r["marker"]) for r in rc.scan_parts(rows, languages).collect()}
    assert found == {("p", "word/numbering.xml", 0, "lvlText", "artikel [0-9]+"), ("p", "word/footnotes.xml", 1, "t", "Partijen"), ("q", "word/comments.xml", 0, "t", "delle")}


def test_heads():
    assert rc.heads(r"surs[eé]ance") == ["surs"] and rc.heads("artikel [0-9]+") == ["artikel "] and rc.heads("Ab*c") == ["a"]
    assert rc.heads(r"(?i)\b(?:Reiwa|Heisei)\s+\d") == ["reiwa", "heisei"]
    with pytest.raises(ValueError):
        rc.heads(r"\d+ x")
