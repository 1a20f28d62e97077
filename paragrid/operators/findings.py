"""Rules against texts, findings, and their rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.functions.text import folded, literal_in

#: Order of severities in rollups.
SEVERITIES = ["PASS", "WARN", "BLOCK"]


def rule_counts(rows: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """rows with one column of match counts for each (name, pattern): one pass, no join."""
    return rows.withColumns({name: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for name, p in rules})


def findings(rows: DataFrame, checks: list[tuple[str, str, Column]], keys: list[str]) -> DataFrame:
    """keys, check, severity, n: one row for each check whose count is above zero, in one pass over the rows.

    The outer form, as Catalyst puts a filter before the inner one that computes all checks a second time."""
    each = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), n.cast("long").alias("n")) for name, severity, n in checks])
    return rows.select(*keys, F.inline_outer(F.filter(each, lambda c: c["n"] > 0))).where("check is not null")


def rule_join(entries: DataFrame, rules: DataFrame, text: str = "text", language: Column | None = None, most_rules: int = 10_000, most_bytes: int = 8 << 20, most_fixed: int = 400) -> DataFrame:
    """entries with the rules that match them. A rule holds for its language, for all (``*``), or when the entry's is unknown (``*``).

    Rule tables are small by nature and go to every task; the number of rules and their bytes are checked. Up to ``most_fixed`` rules are
    fixed patterns, compiled once; patterns read from rows are compiled for every pair of an entry and a rule."""
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern")), F.lit(0))).first()
    if n > most_rules or size > most_bytes:
        raise ValueError(f"more than {most_rules} rules or {most_bytes} bytes of patterns: split the table")
    entry_language = F.lit("*") if language is None else language
    holds = (F.col("language") == "*") | (F.col("language") == entry_language) | (entry_language == "*")
    if n > most_fixed:
        return entries.join(F.broadcast(rules), F.regexp_like(text, F.col("pattern")) & holds)
    patterns = [r[0] for r in rules.where("pattern is not null").select("pattern").distinct().collect()]
    held = lambda p, t: F.contains(t, F.lit(literal_in(p))) if literal_in(p) else F.lit(True)
    hits = lambda t: F.array(*[F.when(held(p, t) & F.regexp_like(text, F.lit(p)), F.lit(p)) for p in patterns]).cast("array<string>")
    found = entries.withColumn("__hit", F.explode_outer(F.array_compact(F.transform(F.array(folded(F.col(text))), hits)[0]))).where("__hit is not null")
    return found.join(F.broadcast(rules), (F.col("__hit") == F.col("pattern")) & holds).drop("__hit")


def counts_by_check(found: DataFrame, checks: list[str]) -> DataFrame:
    """check, n_docs, n: all checks, those without findings too."""
    spark = found.sparkSession
    sums = found.groupBy("check").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n").alias("n"))
    return spark.createDataFrame([(c,) for c in checks], "check string").join(sums, "check", "left").na.fill(0)


def severity_of(found: Column) -> Column:
    return reduce(lambda c, k: F.when(found == SEVERITIES[k], k).otherwise(c), range(len(SEVERITIES)), F.lit(0))


def severity_rollup(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, n_findings, n_checks, severity: the worst, PASS for documents without findings."""
    sums = found.groupBy("doc_id").agg(F.sum("n").alias("n_findings"), F.countDistinct("check").alias("n_checks"), F.max(severity_of(F.col("severity"))).alias("worst"))
    out = docs.select("doc_id").join(sums, "doc_id", "left").na.fill(0)
    return out.select("doc_id", "n_findings", "n_checks", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("worst") + 1).alias("severity"))


def verdict(rollup: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, exit_code: 2 for blocked documents, 1 for warnings where strict, else 0."""
    return rollup.select("doc_id", F.when(F.col("severity") == "BLOCK", 2).when((F.col("severity") == "WARN") & F.lit(strict), 1).otherwise(0).alias("exit_code"))


def first_n(found: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each group, with how many more there are."""
    from pyspark.sql import Window

    at = Window.partitionBy(*keys).orderBy(*order)
    counted = found.withColumns({"place": F.row_number().over(at), "more": F.count("*").over(Window.partitionBy(*keys)) - n})
    return counted.where(F.col("place") <= n).withColumn("more", F.greatest(F.lit(0), "more")).drop("place")


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).count().orderBy(F.desc("count"), column).limit(n)
