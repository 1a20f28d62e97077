"""Coverage state of incremental validation, freshness by content, drift against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 35


def not_yet(current: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("doc_id", "idx")) -> DataFrame:
    """Rows of current that the log doesn't hold."""
    return current.join(log.select(*keys).distinct(), list(keys), "left_anti")


def places_left(docs: DataFrame, places: Column, log: DataFrame, doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """doc, idx: the places (an array) of each document that the log doesn't hold. Only what the log holds of a document travels, not its places."""
    seen = log.groupBy(doc).agg(F.collect_set(idx).alias("__seen"))
    left = F.array_except(places, F.coalesce("__seen", F.array().cast(log.select(F.array(idx)).schema[0].dataType)))
    return docs.join(seen, doc, "left").select(doc, F.explode_outer(left).alias(idx)).where(F.col(idx).isNotNull())


def batches_over_cap(log: DataFrame, batch: str = "batch", doc: str = "doc_id", cap: int = CAP, override: Column | None = None) -> DataFrame:
    """doc, batch, n of batches with more new rows than the cap, overridden ones excepted."""
    made = log.withColumn("__o", F.lit(False) if override is None else override)
    return made.groupBy(doc, batch).agg(F.count("*").alias("n"), F.max("__o").alias("o")).where((F.col("n") > cap) & ~F.col("o")).drop("o")


def merged_state(log: DataFrame, time: str, doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """doc, idx, first_seen, last_seen, times: appending is idempotent by (doc, idx)."""
    return log.groupBy(doc, idx).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("times"))


def latest(log: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last row of each key. A maximum that is taken before the shuffle, so that a key with very many rows costs no more."""
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in log.columns]), F.struct(F.col(time), F.col(tie)))
    return log.groupBy(F.col(key).alias("__k")).agg(last.alias("__r")).select("__r.*")


def freshness(items: DataFrame, evidence: DataFrame, key: str, content: str) -> DataFrame:
    """key, status: fresh, stale or missing, or not_applicable where the evidence says so. evidence: (key, sha256, not_applicable)."""
    now = items.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("now"))
    status = F.when(F.coalesce("not_applicable", F.lit(False)), "not_applicable").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("now"), "fresh").otherwise("stale")
    return now.join(evidence, key, "left").select(key, status.alias("status"))


def drift(baseline: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, change: gone, new or changed; null values are values."""
    a, b = baseline.select(*keys, F.col(value).alias("was"), F.lit(True).alias("ina")), current.select(*keys, F.col(value).alias("now"), F.lit(True).alias("inb"))
    change = F.when(F.col("inb").isNull(), "gone").when(F.col("ina").isNull(), "new").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change")).where("change is not null")


def unknown_findings(found: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Findings that aren't declared."""
    return found.join(declared.select(*keys).distinct(), keys, "left_anti")
