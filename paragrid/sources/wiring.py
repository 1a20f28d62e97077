"""Parts made ready to be packed: names, orphans, relations, empty properties, and gates before anything is written.

``wired`` changes only what packing needs: folder names of one spelling, custom items without properties or relations gone with the relations
that point at them, relation ids of one form, targets inside the package relative, empty run properties out of the text, and the switch that
tracks further revisions off. ``gated`` parts packages with blocking findings from the rest.

Defined cases: names that differ in case only are one part, the first in order of name stays; parts without content (errors) are left
out; a package that only has orphans keeps nothing of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAIN, SETTINGS = "word/document.xml", "word/settings.xml"
_ITEM = r"(?i)^customXml/item(\d+)\.xml$"


def part_name(name: Column) -> Column:
    """A part's name with the custom folder in its one spelling."""
    return F.regexp_replace(name, "(?i)^customxml/", "customXml/")


def orphans(parts: DataFrame) -> DataFrame:
    """path, number of custom items without properties or relations."""
    low = parts.select("path", F.lower(part_name(F.col("part"))).alias("part"))
    has = lambda p: F.nullif(F.regexp_extract("part", p, 1), F.lit(""))
    kinds = low.select("path", has(r"^customxml/item(\d+)\.xml$").alias("item"), has(r"^customxml/itemprops(\d+)\.xml$").alias("props"), has(r"^customxml/_rels/item(\d+)\.xml\.rels$").alias("rels"))
    numbers = kinds.select("path", F.coalesce("item", "props", "rels").alias("number"), F.col("item").isNotNull().alias("i"), F.col("props").isNotNull().alias("p"), F.col("rels").isNotNull().alias("r")).where("number is not null")
    return numbers.groupBy("path", "number").agg(F.max("i").alias("i"), F.max("p").alias("p"), F.max("r").alias("r")).where("i and not (p and r)").select("path", "number")


def _numbered_ids(text: str) -> str:
    """Relation ids that aren't rId and a number get the next numbers, in their order."""
    ids = re.findall(r'\bId="([^"]+)"', text)
    last = max((int(i[3:]) for i in ids if re.fullmatch(r"rId\d+", i)), default=0)
    for old in dict.fromkeys(i for i in ids if not re.fullmatch(r"rId\d+", i)):
        last += 1
        text = text.replace(f'Id="{old}"', f'Id="rId{last}"')
    return text


def _relations(text: str | None, gone: list[str] | None, in_word: bool, is_types: bool) -> str | None:
    """A relations part (or the list of types) after its fixes; small texts, a few for each package."""
    if text is None:
        return None
    text = re.sub(r"(?i)(?<=/)customxml(?=/)", "customXml", text)
    for number in gone or []:
        text = re.sub(rf'<Relationship\b[^>]*Target="[^"]*item{number}\.xml"[^>]*/>\s*', "", text)
    if in_word:
        text = re.sub(r'(?i)Target="/customxml/', 'Target="../customXml/', text)
    return text if is_types else _numbered_ids(text)


def wired(parts: DataFrame, clean_settings: bool = True) -> DataFrame:
    """path, part, content, error of the parts as they are packed."""
    named = parts.where("part is not null and content is not null").withColumn("name", part_name(F.col("part")))
    first = F.row_number().over(Window.partitionBy("path", F.lower("name")).orderBy("part"))
    single = named.withColumn("k", first).where("k = 1").drop("k")
    lost = orphans(single.select("path", F.col("name").alias("part"))).groupBy("path").agg(F.array_sort(F.collect_set("number")).alias("gone"))
    joined = single.join(lost, "path", "left").withColumn("item", F.regexp_extract("name", _ITEM, 1))
    kept = joined.where(~F.coalesce(F.array_contains("gone", F.col("item")), F.lit(False)))
    text, types = F.col("content").cast("string"), F.col("name") == "[Content_Types].xml"
    relations = F.udf(_relations, StringType())
    made = (
        F.when(F.col("name") == MAIN, F.regexp_replace(text, r"<w:rPr/>|<w:rPr></w:rPr>", ""))
        .when((F.col("name") == SETTINGS) & F.lit(clean_settings), F.regexp_replace(text, r"<w:trackRevisions\b[^>]*/>|<w:trackRevisions\b[^>]*>[^<]*</w:trackRevisions>", ""))
        .when(F.col("name").endswith(".rels") | types, relations(text, F.col("gone"), F.col("name").startswith("word/_rels/"), types))
    )
    return kept.select("path", F.col("name").alias("part"), F.coalesce(made.cast("binary"), F.col("content")).alias("content"), F.lit(None).cast("string").alias("error"))


def gated(parts: DataFrame, found: DataFrame, blocking: tuple[str, ...] = ("BLOCK", "FAIL")) -> tuple[DataFrame, DataFrame]:
    """(parts of packages that may be packed, path and reasons of those that may not) by findings (path, check, severity)."""
    held = found.where(F.col("severity").isin(*blocking)).groupBy("path").agg(F.array_sort(F.collect_set("check")).alias("reasons"))
    return parts.join(held.select("path"), "path", "left_anti"), held
