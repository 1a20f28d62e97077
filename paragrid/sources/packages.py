"""Word-processing packages: archives of XML parts, read to paragraphs, and written back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.sources.schemas import PART, RUN
from paragrid.sources.tables import map_rows

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OFF = ("0", "false", "off")


def packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def parts(found: DataFrame) -> DataFrame:
    """path, part, content, error: a row per archive member; one row with the error for what is no archive."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, n, z.read(n), None) for n in z.namelist() if not n.endswith("/")]
                except (zipfile.BadZipFile, EOFError, OSError) as e:
                    rows = [(path, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "part", "content", "error"])

    return found.select("path", "content").mapInPandas(run, PART)


def _on(properties, name: str) -> bool | None:
    """Tri-state flag: present without a value is on."""
    found = None if properties is None else properties.find(W + name)
    return None if found is None else (found.get(W + "val") or "true").lower() not in OFF


def _value(properties, name: str) -> str | None:
    found = None if properties is None else properties.find(W + name)
    return None if found is None else found.get(W + "val")


_TEXTS, _TAB, _CR, _BR, _TYPE = (W + "t", W + "delText"), W + "tab", W + "cr", W + "br", W + "type"


def _pieces(run) -> str:
    text = ""
    for e in run:
        if e.tag in _TEXTS:
            text += e.text or ""
        elif e.tag == _TAB:
            text += "\t"
        elif e.tag == _CR or (e.tag == _BR and e.get(_TYPE) != "page"):
            text += "\n"
    return text


def _own_runs(p, kind: str = "regular"):
    """(run, kind of its revision) of a paragraph in order, not those of paragraphs within it."""
    for e in p:
        if e.tag == W + "r":
            yield e, kind
        elif e.tag in (W + "ins", W + "moveTo"):
            yield from _own_runs(e, "ins" if kind in ("regular", "ins") else "ins_then_del")
        elif e.tag in (W + "del", W + "moveFrom"):
            yield from _own_runs(e, "del" if kind in ("regular", "del") else "ins_then_del")
        elif e.tag != W + "p" and e.tag != W + "pPr":
            yield from _own_runs(e, kind)


def paragraph_rows(xml: bytes, with_runs: bool = True) -> list[tuple]:
    """Rows of a part: idx, text, style, numId, ilvl, bold, italic, has_track_changes, runs, segments; empty paragraphs are left out but counted."""
    rows = []
    for idx, p in enumerate(ElementTree.fromstring(xml).iter(W + "p")):
        of = p.find(W + "pPr")
        number = None if of is None else of.find(W + "numPr")
        base = None if of is None else of.find(W + "rPr")
        text, runs, segments = "", [], []
        for run, kind in _own_runs(p):
            piece = _pieces(run)
            if not piece:
                continue
            if kind in ("regular", "ins") and with_runs:
                props = run.find(W + "rPr")
                fonts = None if props is None else props.find(W + "rFonts")
                flag = lambda n, props=props: bool(_on(props, n) if _on(props, n) is not None else _on(base, n))
                runs.append((len(text), len(text) + len(piece), piece, flag("b"), flag("i"), (_value(props, "u") or "none") != "none", None if fonts is None else fonts.get(W + "ascii"), _value(props, "sz") or _value(base, "sz"), _value(props, "color")))
            if kind in ("regular", "ins"):
                text += piece
            if segments and segments[-1][0] == kind:
                segments[-1] = (kind, segments[-1][1] + piece)
            else:
                segments.append((kind, piece))
        if text.strip() or segments:
            tracked = any(k != "regular" for k, _ in segments)
            rows.append((idx, text, _value(of, "pStyle"), _value(number, "numId"), _value(number, "ilvl"), _on(base, "b"), _on(base, "i"), tracked, runs, segments if tracked else []))
    return rows


PARAGRAPH_ROW = f"path string, part string, idx int, text string, style string, numId string, ilvl string, p_bold boolean, p_italic boolean, has_track_changes boolean, runs array<{RUN}>, tc_segments array<struct<type:string,text:string>>, error string"


def paragraphs(found: DataFrame, part: str = "word/document.xml|word/(header|footer)[0-9]*.xml", runs: bool = True) -> DataFrame:
    """Paragraph rows of the parts whose name matches; ill-formed XML gives a row with its error. Without ``runs`` that column is empty."""

    def of_part(path: str, name: str, content: bytes) -> list[tuple]:
        try:
            return [(path, name, *r, None) for r in paragraph_rows(content, runs)]
        except ElementTree.ParseError as e:
            return [(path, name, *[None] * 10, str(e))]

    return map_rows(found.where(F.col("part").rlike(f"^(?:{part})$")).select("path", "part", "content"), of_part, PARAGRAPH_ROW)


def revision_counts(found: DataFrame) -> DataFrame:
    """path, part, n_ins, n_del, n_move, authors of the parts' raw XML."""
    text = F.col("content").cast("string")
    return found.where("content is not null and part like '%.xml'").select(
        "path", "part", F.regexp_count(text, F.lit(r"<w:ins\b")).alias("n_ins"), F.regexp_count(text, F.lit(r"<w:del\b")).alias("n_del"), F.regexp_count(text, F.lit(r"<w:move(?:From|To)\b")).alias("n_move"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r'w:author="([^"]*)"'), 1))).alias("authors"),
    )


def comments(found: DataFrame) -> DataFrame:
    """path, id, text of each comment."""
    text = F.col("content").cast("string")
    each = found.where("part = 'word/comments.xml'").select("path", F.explode(F.regexp_extract_all(text, F.lit(r"(?s)(<w:comment\b.*?</w:comment>)"), 1)).alias("c"))
    return each.select("path", F.regexp_extract("c", r'w:id="([^"]*)"', 1).alias("id"), F.array_join(F.regexp_extract_all("c", F.lit(r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t>"), 1), "").alias("text"))


def accept_revisions(xml):
    """A column of raw XML with insertions unwrapped and deletions gone."""
    dropped = F.regexp_replace(xml, r"(?s)<w:(del|moveFrom)\b[^>]*(?<!/)>.*?</w:\1>|<w:(?:del|moveFrom|ins|moveTo)\b[^>]*/>", "")
    return F.regexp_replace(dropped, r"</?w:(?:ins|moveTo)\b[^>]*>", "")


def repack(original: DataFrame, replaced: DataFrame) -> DataFrame:
    """path, content, error: packages with parts replaced by (path, part, content). Names are told apart without case, the
    first stays; each archive is checked by reading it again."""
    merged = original.where("part is not null").alias("o").join(replaced.alias("r"), (F.col("o.path") == F.col("r.path")) & (F.lower("o.part") == F.lower("r.part")), "left")
    members = merged.select("o.path", "o.part", F.coalesce("r.content", "o.content").alias("content"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            done: set[str] = set()
            for name, content in sorted(zip(rows["part"], rows["content"]), key=lambda r: (r[0] != "[Content_Types].xml", r[0])):
                if name.lower() not in done:
                    done.add(name.lower())
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        bad = zipfile.ZipFile(io.BytesIO(out.getvalue())).testzip()
        return pd.DataFrame([(rows["path"].iloc[0], out.getvalue(), bad)], columns=["path", "content", "error"])

    return members.groupBy("path").applyInPandas(build, "path string, content binary, error string")  # a package a group
