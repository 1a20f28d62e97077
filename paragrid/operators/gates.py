"""Gates over findings and inputs: PASS, WARN, BLOCK, and VOID where nothing was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.operators.definitions import sections
from paragrid.operators.findings import rule_join, severity_of
from paragrid.operators.state import CAP, not_yet

#: Order of verdicts: a gate that read nothing isn't clean.
VERDICTS = ["PASS", "WARN", "BLOCK", "VOID"]
#: Bytes of text that ``carried`` sends to all tasks.
MOST_BYTES = 8 << 20


def gate(examined: DataFrame, found: DataFrame) -> DataFrame:
    """One row: examined, findings, verdict."""
    read = examined.agg(F.count("*").alias("examined"))
    worst = found.agg(F.count("*").alias("findings"), F.coalesce(F.max(severity_of(F.col("severity"))), F.lit(0)).alias("w"))
    verdict = F.when(F.col("examined") == 0, "VOID").otherwise(F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("w") + 1))
    return read.crossJoin(worst).select("examined", "findings", verdict.alias("verdict"))  # one row by one row


def combined(gates: DataFrame) -> DataFrame:
    """One row: the worst verdict of gates (name, verdict), and the names that have it."""
    rank = sum((F.when(F.col("verdict") == v, k).otherwise(0) for k, v in enumerate(VERDICTS)), F.lit(0))
    ranked = gates.withColumn("r", rank)
    top = ranked.agg(F.max("r").alias("top"))
    return ranked.join(F.broadcast(top), F.col("r") == F.col("top")).groupBy("verdict").agg(F.array_sort(F.collect_set("name")).alias("names"))


def coverage_gate(paragraphs: DataFrame, log: DataFrame, cap: int = CAP, override: bool = False) -> DataFrame:
    """doc_id, new, missing, verdict: BLOCK where more new translations than the cap came at once, WARN where some are missing."""
    has = F.trim(F.coalesce("en", F.lit(""))) != ""
    new = not_yet(paragraphs.where(has), log).groupBy("doc_id").agg(F.count("*").alias("new"))
    missing = paragraphs.groupBy("doc_id").agg(F.sum((~has & (F.trim(F.coalesce("text", F.lit(""))) != "")).cast("int")).alias("missing"))
    verdict = F.when((F.col("new") > cap) & ~F.lit(override), "BLOCK").when(F.col("missing") > 0, "WARN").otherwise("PASS")
    return missing.join(new, "doc_id", "left").na.fill(0).select("doc_id", "new", "missing", verdict.alias("verdict"))


def definition_gate(paragraphs: DataFrame) -> DataFrame:
    """doc_id, idx of paragraphs in a definition section without formatted target runs."""
    spans = sections(paragraphs.select("doc_id", "idx", F.coalesce("en", "text").alias("text")))
    inside = paragraphs.join(spans.select("doc_id", "first", "last"), "doc_id").where(F.col("idx").between(F.col("first"), F.col("last")))
    return inside.where(F.size(F.coalesce("en_runs", F.array().cast("array<struct<start:int,end:int,bold:boolean,italic:boolean>>"))) == 0).select("doc_id", "idx")


def scan_lines(lines: DataFrame, patterns: DataFrame, key: str = "file") -> DataFrame:
    """key, line, pattern, match_hash: the first match of each pattern on each line, hashed so that a report repeats nothing."""
    rules = patterns.select("pattern", F.lit("*").alias("language"))
    hit = rule_join(lines, rules)
    found = F.regexp_substr("text", F.col("pattern"))
    return hit.select(key, "line", "pattern", F.substring(F.sha2(found.cast("binary"), 256), 1, 12).alias("match_hash"))


def consistent(claims: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """label, values of figures that are given with more than one value."""
    return claims.groupBy(label).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def carried(items: DataFrame, texts: DataFrame, item: str = "item", name: str = "name") -> DataFrame:
    """item, places: in which texts each item stands, white space and case aside; nowhere is an empty list. texts go to all tasks; their bytes are checked."""
    if (texts.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"more than {MOST_BYTES} bytes of texts: split the table")
    norm = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    hits = items.join(F.broadcast(texts), F.contains(norm(F.col("text")), norm(F.col(item))), "left")
    return hits.groupBy(item).agg(F.array_sort(F.collect_set(name)).alias("places"))


def expand_ids(spec: Column) -> Column:
    """Id lists with ranges such as A1-A5, B2 as arrays of ids."""
    number = lambda s, p: F.nullif(F.regexp_extract(s, p, 1), F.lit("")).cast("int")
    one = F.transform(
        F.split(F.regexp_replace(spec, "–", "-"), r"\s*,\s*"),
        lambda s: F.struct(F.regexp_extract(s, "^([A-Za-z]*)", 1).alias("p"), number(s, r"^[A-Za-z]*(\d+)").alias("a"), F.coalesce(number(s, r"-[A-Za-z]*(\d+)$"), number(s, r"^[A-Za-z]*(\d+)")).alias("b")),
    )
    return F.flatten(F.transform(one, lambda r: F.transform(F.sequence(r["a"], r["b"]), lambda k: F.concat(r["p"], k.cast("string")))))
