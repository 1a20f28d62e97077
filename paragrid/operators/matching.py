"""Matching texts of two versions: exact and nearest, by prefix, by shared tokens; one to one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragrid.functions.text import normalized, tokens
from paragrid.sources.tables import written


def nearest_exact(left: DataFrame, right: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc, idx, match_idx, match_kind: each left row's partner of equal normalized text, one to one.

    Texts that stand once on both sides are joined; only repeated texts are assigned in order within a document,
    each to the nearest free place (the first of equally near ones)."""
    key = F.xxhash64(normalized(F.col(text)))
    a = left.select(F.col(doc).alias("doc_id"), F.col(order).alias("idx"), key.alias("k"))
    b = right.select(F.col(doc).alias("doc_id"), F.col(order).alias("idx"), key.alias("k"))
    group = Window.partitionBy("doc_id", "k")
    na = a.withColumn("n", F.count("*").over(group))
    nb = b.withColumn("m", F.count("*").over(group)).withColumnRenamed("idx", "match_idx")
    once = na.where("n = 1").join(nb.where("m = 1"), ["doc_id", "k"]).select("doc_id", "idx", "match_idx", F.lit("exact").alias("match_kind"))
    again = na.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list("idx")).alias("wanted")).join(nb.groupBy("doc_id", "k").agg(F.sort_array(F.collect_list("match_idx")).alias("free")), ["doc_id", "k"]).where((F.size("wanted") > 1) | (F.size("free") > 1))

    def assign(batches):
        for batch in batches:
            rows = []
            for d, wanted, free in zip(batch["doc_id"], batch["wanted"], batch["free"]):
                free = list(free)
                for i in wanted:
                    if not free:
                        break
                    best = min(free, key=lambda f: (abs(f - i), f))
                    free.remove(best)
                    rows.append((d, i, best, "nearest"))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "match_idx", "match_kind"])

    schema = f"doc_id {left.schema[doc].dataType.simpleString()}, idx long, match_idx long, match_kind string"
    several = again.mapInPandas(assign, schema)
    return once.select("doc_id", F.col("idx").cast("long"), F.col("match_idx").cast("long"), "match_kind").unionByName(several)


def prefix_candidates(left: DataFrame, right: DataFrame, length: int = 30, least: int = 10, text: str = "text") -> DataFrame:
    """Pairs (a, b) of rows of which the right one's text begins with the first ``length`` characters of the left one's, or
    with all of it where it is shorter; left texts shorter than ``least`` don't take part.

    Right rows are keyed by their beginnings of each length that a left row has, so that this is an equi join."""
    a = left.withColumn("p", F.substring(normalized(F.col(text)), 1, length)).where(F.length("p") >= least)
    kept = F.substring(normalized(F.col(text)), 1, length)
    begins = F.transform(F.sequence(F.lit(least), F.length("__n")), lambda n: F.substring(F.col("__n"), F.lit(1), n))
    b = right.withColumn("__n", kept).where(F.length("__n") >= least).withColumn("p", F.explode_outer(begins)).drop("__n")
    return a.alias("a").join(b.alias("b"), F.col("a.p") == F.col("b.p"))


def nearest_by_prefix(left: DataFrame, right: DataFrame, taken: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc_id, idx, match_idx, match_kind: what ``nearest_exact`` (taken) left over, one to one by the beginnings of texts.

    Left rows choose in order; each takes, of the right texts that begin with its first 30 characters, the first one (by its first
    row) that has a free row, and of its rows the nearest. The rows that begin alike meet in one group, by document and first
    ten characters, which all candidates share."""
    done = taken.select("doc_id", "idx", "match_idx")
    a = left.select(F.col(doc).alias("doc_id"), F.col(order).cast("long").alias("idx"), normalized(F.col(text)).alias("t")).where("length(t) >= 10").join(done.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    b = right.select(F.col(doc).alias("doc_id"), F.col(order).cast("long").alias("idx"), normalized(F.col(text)).alias("t")).where("length(t) >= 10").join(done.select("doc_id", F.col("match_idx").alias("idx")), ["doc_id", "idx"], "left_anti")
    begin, seen = F.substring("t", 1, 10).alias("begin"), F.xxhash64("t").alias("h")

    def claim(wanted: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        texts: dict[int, list] = {}
        for r in free.sort_values("idx").itertuples():
            texts.setdefault(r.h, [r.p, []])[1].append(r.idx)
        out = []
        for r in wanted.sort_values("idx").itertuples():
            rows = next((rows for p, rows in texts.values() if rows and p.startswith(r.p)), None)
            if rows:
                best = min(rows, key=lambda i: (abs(i - r.idx), i))
                rows.remove(best)
                out.append((r.doc_id, r.idx, best, "prefix"))
        return pd.DataFrame(out, columns=["doc_id", "idx", "match_idx", "match_kind"])

    cut = F.substring("t", 1, 30).alias("p")
    sides = [x.select("doc_id", begin, "idx", cut, seen).groupBy("doc_id", "begin") for x in (a, b)]
    return sides[0].cogroup(sides[1]).applyInPandas(claim, f"doc_id {left.schema[doc].dataType.simpleString()}, idx long, match_idx long, match_kind string")


def overlap_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str = "text", share: float = 0.0) -> DataFrame:
    """left_id, right_id, shared, wanted: numbers of tokens in common and of the left side's, where these hold the share of them.

    A text that shares so many holds one of the left side's rarest tokens at least, one more than may be missing; only these are joined, and
    what is shared in all is counted on the pairs that they give. The right side's tokens are found once; those that the left side has are kept. Without a share any common token makes a pair."""
    a = left.select(left_id, tokens(F.col(text)).alias("w"))
    each = right.select(right_id, F.explode_outer(tokens(F.col(text))).alias("t"))  # the inner form would find the tokens twice
    b = written(each.join(a.select(F.explode_outer("w").alias("t")).distinct(), "t", "left_semi"), "shared")
    often = b.groupBy("t").agg(F.count("*").alias("n"))
    asked = a.select(left_id, F.size("w").alias("wanted"), F.explode("w").alias("t")).join(often, "t", "left")
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy(F.coalesce("n", F.lit(0)), "t"))
    least = F.greatest(F.ceil(F.col("wanted") * share), F.lit(1))
    rare = asked.withColumn("rank", rank).where(F.col("n").isNotNull() & (F.col("rank") <= F.col("wanted") - least + 1)).select(left_id, "t")
    pairs = written(rare.join(b, "t").select(left_id, right_id).distinct(), "pairs")
    there = b.join(pairs.select(right_id).distinct(), right_id, "left_semi").groupBy(right_id).agg(F.collect_list("t").alias("there"))
    both = pairs.join(a, left_id).join(there, right_id)
    counted = both.select(left_id, right_id, F.size(F.array_intersect("w", "there")).cast("long").alias("shared"), F.size("w").alias("wanted"))
    return counted.where((F.col("shared") >= share * F.col("wanted")) & (F.col("shared") >= 1))


def greedy_overlap(left: DataFrame, right: DataFrame, share: float = 0.5, text: str = "text", doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """doc, idx, match_idx, shared: within a document, left rows by falling number of tokens claim the free right row that
    shares most (the first of equals), if it holds the share of their tokens. A row that finds none gets the right row of its own
    place among rows with tokens (on the right: with text), if that is free; shared is null then. A document's candidates meet in one task."""
    a = left.select(F.col(doc).alias("doc_id"), F.col(order).alias("idx"), tokens(F.col(text)).alias("t"))
    b = right.select(F.col(doc).alias("doc_id"), F.col(order).alias("match_idx"), tokens(F.col(text)).alias("t"))
    pairs = a.select("doc_id", "idx", F.size("t").alias("wanted"), F.explode("t").alias("t")).join(b.select("doc_id", "match_idx", F.explode("t").alias("t")), ["doc_id", "t"])
    counted = pairs.groupBy("doc_id", "idx", "match_idx").agg(F.count("*").alias("shared"), F.first("wanted").alias("wanted")).where(F.col("shared") >= share * F.col("wanted"))

    def claim(rows: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for (_, idx), group in rows.assign(rank=-rows["wanted"]).sort_values(["rank", "idx"]).groupby(["rank", "idx"]):
            for r in group.sort_values(["shared", "match_idx"], ascending=[False, True]).itertuples():
                if r.match_idx not in used:
                    used.add(r.match_idx)
                    out.append((r.doc_id, idx, r.match_idx, r.shared))
                    break
        return pd.DataFrame(out, columns=["doc_id", "idx", "match_idx", "shared"])

    claimed = written(counted.groupBy("doc_id").applyInPandas(claim, f"doc_id {left.schema[doc].dataType.simpleString()}, idx long, match_idx long, shared long"), "claims")
    place = lambda by: F.row_number().over(Window.partitionBy("doc_id").orderBy(by)).alias("place")
    placed = a.where(F.size("t") > 0).select("doc_id", F.col("idx").cast("long").alias("idx"), place("idx"))
    at = right.where(F.col(text).rlike(r"(?U)\S")).select(F.col(doc).alias("doc_id"), F.col(order).cast("long").alias("match_idx")).select("doc_id", "match_idx", place("match_idx"))
    left_over = placed.join(claimed.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti").join(at, ["doc_id", "place"])
    by_place = left_over.join(claimed.select("doc_id", "match_idx"), ["doc_id", "match_idx"], "left_anti").select("doc_id", "idx", "match_idx", F.lit(None).cast("long").alias("shared"))
    return claimed.unionByName(by_place)


def missing_tokens(wanted: DataFrame, applied: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "idx")) -> DataFrame:
    """keys, missing: tokens of the wanted text that the applied one lacks."""
    a = wanted.select(*keys, tokens(F.col(text)).alias("w"))
    b = applied.select(*keys, tokens(F.col(text)).alias("a"))
    return a.join(b, list(keys), "left").select(*keys, F.array_except("w", F.coalesce("a", F.array().cast("array<string>"))).alias("missing")).where(F.size("missing") > 0)
