"""Comparing trees of records, resolving citations, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.functions.text import words


def parity(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, status: left_only, right_only, differs or same; of repeated keys the greatest value counts."""
    a, b = left.groupBy(*keys).agg(F.max(value).alias("a")), right.groupBy(*keys).agg(F.max(value).alias("b"))
    a, b = a.withColumn("ina", F.lit(True)), b.withColumn("inb", F.lit(True))
    status = F.when(F.col("inb").isNull(), "left_only").when(F.col("ina").isNull(), "right_only").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("differs")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def chained(rows: DataFrame, place: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison of each tree with the next: rows with pair, the place of the earlier one. One join of them compares all."""
    last = rows.agg(F.max(place)).first()[0]
    return rows.where(F.col(place) < F.lit(last)).withColumn("pair", F.col(place)), rows.where(F.col(place) > 0).withColumn("pair", F.col(place) - 1)


def unresolved(citations: DataFrame, headings: DataFrame, cited: str = "cited", heading: str = "heading") -> DataFrame:
    """Citations whose words aren't the first words of any heading. Headings are keyed by each of their beginnings, so that this is an equi join."""
    starts = headings.select(words(F.col(heading)).alias("w")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("k")).distinct()
    keyed = citations.withColumn("k", F.array_join(words(F.col(cited)), " "))
    return keyed.join(starts, "k", "left_anti").drop("k")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def set_relation(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """value, side: left, right or both."""
    a, b = left.select(value).distinct().withColumn("a", F.lit(1)), right.select(value).distinct().withColumn("b", F.lit(1))
    return a.join(b, value, "full_outer").select(value, F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").otherwise("both").alias("side"))


def linear_fit(rows: DataFrame, y: str, x: str) -> DataFrame:
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
