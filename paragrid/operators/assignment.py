"""Rows of one version find their rows in another, in turn: the same text first, else a text that begins alike, one to one.

The rule is that of a queue. Left rows come by their order; each looks for free right rows of equal text, and takes the nearest place; if
none is free, it goes through the right texts that begin with its first 30 characters, in the order in which they first stand there, and
takes the nearest free place of the first that has one. What an early row takes is gone for later ones, of either kind.

A queue in which all texts serve the lowest number first has one stable outcome, which rounds of proposals reach. In a round each left row
proposes to the first text that it may still get, and a text with n places takes its n first proposers. A text that is full of earlier rows is
closed to a row for good: who holds it can only give way to still earlier ones. Rows to which the same text of one list is the first open one
share out the places from there by their turn, so that a round serves a whole list at once. Documents in which nobody is turned away
are settled and leave the rounds; those in which every row finds an equal text never enter them. No step gathers a document or the rows that begin alike: rounds are joins on (document, text), (document,
beginning, place) and windows. Only the places of one repeated text in one document, as numbers, come together at the end, where the nearest
free one is found in about logarithmic time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragrid.functions.text import normalized
from paragrid.sources.tables import discard, written


def nearest_free(wanted: list[int], places: list[int]) -> list[int | None]:
    """For each wanted place in turn the nearest free one of the rising places, the smaller of two equally near; it is taken then."""
    right, left = list(range(len(places) + 1)), list(range(len(places) + 1))  # next free at or behind; next free at or before, shifted by one

    def root(up: list[int], k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out: list[int | None] = []
    for w in wanted:
        k = bisect_left(places, w)
        after, before = root(right, k), root(left, k) - 1
        if after == len(places) and before < 0:
            out.append(None)
            continue
        best = after if before < 0 or (after < len(places) and places[after] - w < w - places[before]) else before
        right[best], left[best + 1] = best + 1, best
        out.append(places[best])
    return out


def _prepared(rows: DataFrame, text: str, doc: str, order: str, length: int) -> DataFrame:
    t = normalized(F.col(text))
    return rows.select(F.col(doc).alias("doc_id"), F.col(order).cast("long").alias("idx"), F.xxhash64(t).alias("text"), F.length(t).alias("size"), F.substring(t, 1, length).alias("begin"))


def _next(members: DataFrame, listed: DataFrame, full: DataFrame) -> DataFrame:
    """members (doc_id, idx, text, begin) with ``to``, the text of their list that each proposes to; rows whose lists are closed are left out.

    full (doc_id, text, last): texts that were full, and the last row that they took. Such a text is open to no later row."""
    active = members.where("begin is not null")
    lists = active.groupBy("doc_id", "begin").agg(F.min("idx").alias("earliest"))
    open_to = listed.join(lists, ["doc_id", "begin"]).join(full, ["doc_id", "text"], "left").withColumn("last", F.coalesce("last", F.lit(2**62)))
    by_place = Window.partitionBy("doc_id", "begin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    n = F.when(F.col("last") >= F.col("earliest"), F.col("n")).otherwise(0)
    known = open_to.withColumns({"n": n, "before": F.coalesce(F.max("last").over(by_place), F.lit(-(2**62))), "used": F.coalesce(F.sum(n).over(by_place), F.lit(0))})
    mark = F.struct("last", "used")  # a place that is open to later rows than all places before it, and the places before it
    marks = known.where(F.col("last") > F.col("before")).select("doc_id", "begin", F.col("before").alias("key"), F.lit(1).alias("side"), mark.alias("mark"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("long").alias("text"))
    asked = active.select("doc_id", "begin", F.col("idx").alias("key"), F.lit(0).alias("side"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"), "idx", "text")
    seen = Window.partitionBy("doc_id", "begin").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, 0)
    first_open = marks.unionByName(asked).withColumn("mark", F.last("mark", ignorenulls=True).over(seen)).where("side = 0").where(F.col("mark.last") >= F.col("idx"))
    among = F.row_number().over(Window.partitionBy("doc_id", "begin", "mark.used").orderBy("idx")) - 1
    slots = known.where("n > 0").select("doc_id", "begin", F.col("text").alias("to"), F.explode(F.sequence(F.col("used"), F.col("used") + F.col("n") - 1)).alias("turn"))
    return first_open.withColumn("turn", F.col("mark.used") + among).join(slots, ["doc_id", "begin", "turn"]).select("doc_id", "idx", "text", "begin", "to")


def _in_rounds(a: DataFrame, b: DataFrame, least: int) -> list[DataFrame]:
    """Frames of doc_id, idx, text, to: the text that each left row gets, by rounds of proposals."""
    texts = b.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.first("begin").alias("begin"))
    asked = a.where(F.col("size") >= least).select("doc_id", "begin").distinct()
    sizes = asked.groupBy("doc_id").agg(F.collect_set(F.length("begin")).alias("sizes"))  # at most length - least + 1 numbers
    begins = F.transform(F.filter("sizes", lambda n: n <= F.length("begin")), lambda n: F.substring(F.col("begin"), F.lit(1), n))
    alike = texts.join(sizes, "doc_id").select("doc_id", "text", "n", "first", F.explode(begins).alias("begin")).join(asked, ["doc_id", "begin"])
    listed = written(alike.select("doc_id", F.xxhash64("begin").alias("begin"), (F.row_number().over(Window.partitionBy("doc_id", "begin").orderBy("first")) - 1).alias("place"), "text", "n"), "lists")
    begin = F.when(F.col("size") >= least, F.xxhash64("begin"))
    sized = texts.select("doc_id", F.col("text").alias("to"), "n")
    rows = a.select("doc_id", "idx", "text", begin.alias("begin"))
    exact = rows.join(sized.select("doc_id", F.col("to").alias("text")), ["doc_id", "text"])
    others = rows.join(sized.select("doc_id", F.col("to").alias("text")), ["doc_id", "text"], "left_anti")
    full = written(sized.select("doc_id", F.col("to").alias("text"), F.lit(None).cast("long").alias("last")).limit(0), "full")
    of_list = lambda rows: rows.withColumn("listed", F.lit(True))
    state = written(exact.withColumns({"to": F.col("text"), "listed": F.lit(False)}).unionByName(of_list(_next(others, listed, full))), "queue")
    settled: list[DataFrame] = []
    while True:
        rank = F.row_number().over(Window.partitionBy("doc_id", "to").orderBy("idx"))
        judged = written(state.withColumn("rank", rank).join(sized, ["doc_id", "to"]).withColumn("held", F.col("rank") <= F.col("n")), "proposals")
        open_docs = judged.where("not held").select("doc_id").distinct()
        settled.append(written(judged.join(open_docs, "doc_id", "left_anti").select("doc_id", "idx", "text", "to"), "settled"))
        left_over = judged.join(open_docs, "doc_id", "left_semi")
        if left_over.isEmpty():
            break
        now = left_over.where("rank = n").select("doc_id", F.col("to").alias("text"), F.col("idx").alias("last"))
        full, old, before = written(full.unionByName(now).groupBy("doc_id", "text").agg(F.min("last").alias("last")), "full"), full, state
        stay = left_over.where("held and not listed").select("doc_id", "idx", "text", "begin", "to", "listed")
        members = left_over.where("listed or not held").select("doc_id", "idx", "text", "begin")
        state = written(stay.unionByName(of_list(_next(members, listed, full))), "queue")
        for done in (before, old, judged):
            discard(done)
    return settled


def find_matches(left: DataFrame, right: DataFrame, text: str = "text", doc: str = "doc_id", order: str = "idx", length: int = 30, least: int = 10) -> DataFrame:
    """doc_id, idx, match_idx, match_kind (exact, prefix): each left row's partner by the rule of the queue.

    Rows with null or blank texts, and a null document or order, take no part; beginnings shorter than ``least`` characters find equal
    texts only. Rows of the same order in one document come in no defined turn. Empty tables give an empty result."""
    a = written(_prepared(left, text, doc, order, length).where("doc_id is not null and idx is not null"), "wanted").where("size > 0")  # a filter before writing would normalize twice
    b = written(_prepared(right, text, doc, order, length).where("doc_id is not null and idx is not null"), "places").where("size > 0")
    begin = F.when(F.col("size") >= least, F.xxhash64("begin"))
    sized = b.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("idx"))
    ranked = written(a.select("doc_id", "idx", "text", begin.alias("begin")).withColumn("rank", rank).join(sized, ["doc_id", "text"], "left"), "ranked")
    contested = written(ranked.where("rank > n or (n is null and begin is not null)").select("doc_id").distinct(), "contested")
    served = ranked.where("n is not null").join(contested, "doc_id", "left_anti")  # everybody finds an equal text
    of_these = lambda rows: rows.join(contested, "doc_id", "left_semi")
    settled = [served.where("n > 1").select("doc_id", "idx", "text", F.col("text").alias("to"))]
    if not contested.isEmpty():
        settled += _in_rounds(of_these(a), of_these(b), least)
    held = settled[0]
    for s in settled[1:]:
        held = held.unionByName(s)
    kind = F.when(F.col("text") == F.col("to"), "exact").otherwise("prefix")
    taken = held.select("doc_id", F.col("to").alias("text"), "idx", kind.alias("match_kind"))
    wanted = taken.groupBy("doc_id", "text").agg(F.sort_array(F.collect_list(F.struct("idx", "match_kind"))).alias("wanted"))
    free = b.join(taken.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_semi").groupBy("doc_id", "text").agg(F.sort_array(F.collect_list("idx")).alias("free"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, asking, places in zip(batch["doc_id"], batch["wanted"], batch["free"]):
                order_of = [r["idx"] for r in asking]
                rows += [(d, i, p, r["match_kind"]) for i, p, r in zip(order_of, nearest_free(order_of, list(places)), asking)]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "match_idx", "match_kind"])

    single = (F.size("free") == 1) & (F.size("wanted") == 1)
    both = wanted.join(free, ["doc_id", "text"])
    once = both.where(single).select("doc_id", F.col("wanted")[0]["idx"].alias("idx"), F.col("free")[0].alias("match_idx"), F.col("wanted")[0]["match_kind"].alias("match_kind"))
    several = both.where(~single).mapInPandas(assign, f"doc_id {left.schema[doc].dataType.simpleString()}, idx long, match_idx long, match_kind string")
    alone = served.where("n = 1").select("doc_id", "idx", F.col("first").alias("match_idx"), F.lit("exact").alias("match_kind"))
    return alone.unionByName(once).unionByName(several)
