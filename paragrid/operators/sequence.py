"""Ordered sequences: neighbours, islands, clusters, running groups, look-ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, value: str, doc: str = "doc_id", order: str = "idx", ahead: int = 1) -> DataFrame:
    """rows with before, and after_1 to after_<ahead>."""
    at = Window.partitionBy(doc).orderBy(order)
    return rows.withColumns({"before": F.lag(value).over(at)} | {f"after_{k}": F.lead(value, k).over(at) for k in range(1, ahead + 1)})


def islands(rows: DataFrame, kind: str, doc: str = "doc_id", order: str = "idx", text: str = "text") -> DataFrame:
    """doc, island, kind, first, last, n, text: neighbours of one kind together, texts in order."""
    at = Window.partitionBy(doc).orderBy(order)
    new = ~F.coalesce(F.col(kind).eqNullSafe(F.lag(kind).over(at)) & F.lag(order).over(at).isNotNull(), F.lit(False))
    numbered = rows.withColumn("island", F.sum(new.cast("int")).over(at))
    inside = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return numbered.groupBy(doc, "island").agg(F.first(kind).alias(kind), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.array_join(F.transform(inside, lambda x: x["t"]), "").alias("text"))


def running_group(rows: DataFrame, start: Column, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """rows with group: each start opens one, further rows belong to it; 0 before the first."""
    return rows.withColumn("group", F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(Window.partitionBy(doc).orderBy(order)))


def look_ahead(rows: DataFrame, head: Column, hit: Column, within: int = 8, least: int = 3, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """Rows that are heads with at least so many hits among the next rows."""
    ahead = Window.partitionBy(doc).orderBy(order).rowsBetween(1, within)
    counted = rows.withColumn("hits", F.coalesce(F.sum(F.coalesce(hit, F.lit(False)).cast("int")).over(ahead), F.lit(0)))
    return counted.where(head & (F.col("hits") >= least))


def gap_clusters(rows: DataFrame, hit: Column, gap: int = 20, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc, cluster, first, last, n of the hits that follow each other within a gap."""
    hits = rows.where(hit)
    at = Window.partitionBy(doc).orderBy(order)
    new = F.coalesce(F.col(order) - F.lag(order).over(at) > gap, F.lit(True))
    return hits.withColumn("cluster", F.sum(new.cast("int")).over(at)).groupBy(doc, "cluster").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def level_jumps(rows: DataFrame, level: str, key: str, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """Rows whose level is more than one below the last of the same key, or whose first level is above one."""
    before = F.lag(level).over(Window.partitionBy(doc, key).orderBy(order))
    return rows.withColumn("before", before).where(F.when(F.col("before").isNull(), F.col(level) > 1).otherwise(F.col(level) - F.col("before") > 1))


def near_flag(rows: DataFrame, flag: Column, reach: int = 8, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """rows with near: whether a flagged row stands within reach on either side."""
    around = Window.partitionBy(doc).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("near", F.coalesce(F.max(flag).over(around), F.lit(False)))


def offsets(rows: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """rows with start and end: their places in the joined text."""
    end = F.sum(F.coalesce(F.length(text), F.lit(0))).over(Window.partitionBy(doc).orderBy(order))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.coalesce(F.length(text), F.lit(0)))


def field_regions(rows: DataFrame, mark: str, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """rows with region: instruction, result or outside, from begin, separate and end marks (fields may nest), and zone, the number of fields ended before."""
    at = Window.partitionBy(doc).orderBy(order)
    upto = lambda value: F.sum((F.coalesce(F.col(mark), F.lit("")) == value).cast("int")).over(at)
    begun, parted, ended = upto("begin"), upto("separate"), upto("end")
    region = F.when(begun - ended <= 0, "outside").when(parted - ended >= begun - ended, "result").otherwise("instruction")
    return rows.withColumns({"region": region, "zone": ended})
