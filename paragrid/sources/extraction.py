"""What is read out of packages: the record of each paragraph, two streams of texts, notes and comments with something to translate.

``records`` gives each paragraph the fields that translators and gates look at, clusters of pieces side by side among them; ``streams`` keeps what
is shown and what is deleted apart; ``notes`` leaves out separators and entries without text; ``extract`` reads any of packages, bare parts
and record files into one table of texts.

Defined cases: a part that can't be read has no rows here (``packages.paragraphs`` tells its error); a paragraph without own text has a record
only if it has deleted text."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from xml.parsers.expat import ExpatError

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.operators.formatting import target_entries
from paragrid.sources.markup import Node, own, paragraphs_of, piece, tree
from paragrid.sources.packages import packages, parts
from paragrid.sources.schemas import PARAGRAPH

MAIN, OFF = "word/document.xml", ("0", "false", "off")
NOTES = {"word/comments.xml": "comment", "word/footnotes.xml": "footnote", "word/endnotes.xml": "endnote"}
RECORD = "path string, part string, idx int, text string, deleted_text string, style string, has_track_changes boolean, p_rpr_b string, p_rpr_i string, tc_segments array<struct<type:string,text:string>>, tc_cluster_hits array<struct<type:string,count:int>>"


def _said(node: Node, tag: str) -> str:
    return "".join(n.text for n in node.walk() if n.tag == tag)


def _revision(child: Node) -> tuple[str, str] | None:
    """(kind, text) of a child of a paragraph that is a revision with text."""
    if child.tag in ("del", "moveFrom"):
        text = _said(child, "delText") or (_said(child, "t") if child.tag == "moveFrom" else "")
        return ("del", text) if text else None
    if child.tag in ("ins", "moveTo"):
        shown, gone = _said(child, "t"), _said(child, "delText")
        return ("ins", shown) if shown else ("ins_then_del", gone) if gone else None
    return None


def cluster_hits(p: Node) -> list[tuple[str, int]]:
    """(kind, count) of two or more revisions of one kind side by side; marks between them part them."""
    kinds = [found[0] if (found := _revision(c)) else None for c in p.children if c.tag != "pPr"]
    runs = [(kind, len(list(same))) for kind, same in groupby(kinds)]
    return [(kind, n) for kind, n in runs if kind is not None and n >= 2]


def _mark(p: Node, name: str) -> str | None:
    """A paragraph mark's bold or italic: true, false, or none where it says nothing."""
    props = p.child("pPr").child("rPr") if p.child("pPr") is not None else None
    found = props.child(name) if props is not None else None
    return None if found is None else "false" if (found.get("val") or "true").strip().lower() in OFF else "true"


def _record(p: Node) -> tuple | None:
    text, deleted, segments = "", "", []
    for r, kind, _ in own(p):
        said = piece(r)
        text += said if kind in ("regular", "ins") else ""
        deleted += "" if kind in ("regular", "ins") else said
        if said and segments and segments[-1][0] == kind:
            segments[-1] = (kind, segments[-1][1] + said)
        elif said:
            segments.append((kind, said))
    if not text.strip() and not deleted.strip():
        return None
    tracked = any(kind != "regular" for kind, _ in segments)
    style = p.child("pPr").child("pStyle") if p.child("pPr") is not None else None
    return text, deleted or None, style.get("val") if style is not None else None, tracked, _mark(p, "b"), _mark(p, "i"), segments if tracked else None, (cluster_hits(p) or None) if tracked else None


def _each(found: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows (schema, but for path and part) of each part's content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, part, content in zip(batch["path"], batch["part"], batch["content"]):
                try:
                    rows += [(path, part, *r) for r in rows_of(part, content)]
                except ExpatError:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return found.where("content is not null").select("path", "part", "content").mapInPandas(run, schema)


def records(found: DataFrame, part: str = MAIN) -> DataFrame:
    """RECORD rows of the parts of that name."""
    return _each(found.where(F.col("part") == part), lambda _, content: [(k, *r) for k, p in enumerate(paragraphs_of(content)) if (r := _record(p))], RECORD)


def streams(found: DataFrame, part: str = MAIN) -> DataFrame:
    """path, part, field (t, delText), seq, text: what is shown and what is deleted, each numbered for itself; blank texts are left out but counted."""

    def rows_of(_: str, content: bytes) -> list[tuple]:
        root = tree(content)
        texts = {tag: [n.text for n in [root, *root.walk()] if n.tag == tag] for tag in ("t", "delText")}
        return [(tag, k, t) for tag, all_of in texts.items() for k, t in enumerate(all_of) if t.strip()]

    return _each(found.where(F.col("part") == part), rows_of, "path string, part string, field string, seq int, text string")


def notes(found: DataFrame) -> DataFrame:
    """path, part, kind, id, text of comments, footnotes and endnotes that have text; separators are none."""

    def rows_of(part: str, content: bytes) -> list[tuple]:
        kind, root = NOTES[part], tree(content)
        entries = [n for n in [root, *root.walk()] if n.tag == kind and n.get("type") not in ("separator", "continuationSeparator")]
        return [(kind, n.get("id"), text) for n in entries if (text := _said(n, "t").strip())]

    return _each(found.where(F.col("part").isin(*NOTES)), rows_of, "path string, part string, kind string, id string, text string")


def note_counts(found: DataFrame) -> DataFrame:
    """path, part, n: how much there is to translate beside the text."""
    return notes(found).groupBy("path", "part").agg(F.count("*").alias("n"))


def extract(spark: SparkSession, path: str) -> DataFrame:
    """path, field, idx, text of the packages (.docx), parts (.xml) and record files (.json) under a path.

    Packages and parts give their two streams, record files their translations (en, en_deleted, en_segments[k])."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    bare = files.option("pathGlobFilter", "*.xml").load(path).select("path", F.lit(MAIN).alias("part"), "content")
    packed = parts(packages(spark, path).where("path like '%.docx'")).where("error is null").select("path", "part", "content")
    told = streams(bare.unionByName(packed)).select("path", "field", F.col("seq").alias("idx"), "text")
    known = spark.read.schema(PARAGRAPH).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("doc", F.input_file_name())
    return told.unionByName(target_entries(known).select(F.col("doc").alias("path"), "field", "idx", "text"))
