"""Ranked lexical search: document-sharded postings with whole-number impacts, searched term at a time.

``build_index`` cuts the documents into shards of at most SHARD_DOCS documents and about SHARD_BYTES of text, where they lie, and writes for
each shard its vocabulary and a CSR matrix: where each term's postings start, and of each posting the document's place in the shard and its
impact, which needs only the number N of documents, the number L of all their terms and the document's own terms. ``search`` sends queries in
blocks of about QUERY_BYTES of text to all shards; a shard adds weight times impact into one dense array of its documents, a term at a time,
finds the k-th score by argpartition, keeps all documents above it and of those with that very score the smallest ids. A task merges its
shards' results, and a window merges the tasks'. A block's broadcast is removed as soon as its result is written.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. A term's weight is
floor(1000 * ln((2N + 2) / (2 df + 1))), its impact (1e9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L.

Defined cases: a null or empty text has no terms, is not counted in N and never found; an item without terms, or with terms that no document
holds, has no rows. Repeated rows are documents (items) of their own, so that ids may repeat in a result. A null doc_id comes last among equal
scores. A text longer than SHARD_BYTES is a shard of its own. An empty table of documents or items gives an empty result. Only the named
columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragrid.llm.common import discard, materialize, size_bytes, text_bytes

SHARD_DOCS, SHARD_BYTES, QUERY_BYTES = 65_536, 8 << 20, 1 << 20
#: What stands between terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INDEX = "n_docs int, ids binary, no_id binary, terms binary, starts binary, docs binary, impacts binary"
_FOUND = "query long, doc_id long, score long"


def _folded(c: int) -> int:
    return c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20


_FOLD = bytes(map(_folded, range(256)))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, with repeats."""
    return text.translate(_FOLD).split()


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""
    n = F.regexp_count(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(TERM))
    return tuple(docs.agg(F.count(F.when(n > 0, 1)), F.coalesce(F.sum(n.cast("long")), F.lit(0)).cast("long")).first())


class Shard:
    """Documents on their way into one CSR matrix."""

    def __init__(self):
        self.codes = defaultdict()
        self.codes.default_factory = self.codes.__len__  # a new term gets the next number
        self.ids, self.lengths, self.words, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = terms_of(text)
        if words:
            self.words.append(np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words)))
            self.ids.append(doc_id)
            self.lengths.append(len(words))
            self.bytes += len(text)

    def packed(self, n_docs: int, n_terms: int) -> dict[str, list]:
        size, lengths = len(self.ids), np.array(self.lengths, np.int64)
        doc = np.repeat(np.arange(size), lengths)
        key, tf = np.unique(np.concatenate(self.words) * size + doc, return_counts=True)
        doc = key % size
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * (75 + 25 * lengths * n_docs // n_terms)[doc])
        starts = np.searchsorted(key // size, np.arange(len(self.codes) + 1))
        ids, no_id = np.array([x or 0 for x in self.ids], "<i8"), np.array([x is None for x in self.ids], bool)
        return {"n_docs": [size], "ids": [ids.tobytes()], "no_id": [no_id.tobytes()], "terms": [b" ".join(self.codes)], "starts": [starts.astype("<u4").tobytes()], "docs": [doc.astype("<u4" if size > 65_536 else "<u2").tobytes()], "impacts": [impact.astype("<u4").tobytes()]}


_ARROW = pa.schema([("n_docs", pa.int32()), *((c, pa.binary()) for c in ("ids", "no_id", "terms", "starts", "docs", "impacts"))])


def build_index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard, written in the shared folder; n_docs and n_terms are those of ``totals``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if shard.ids and (len(shard.ids) == SHARD_DOCS or shard.bytes + len(text.as_buffer() or b"") > SHARD_BYTES):
                    yield pa.RecordBatch.from_pydict(shard.packed(n_docs, n_terms), _ARROW)
                    shard = Shard()
                shard.add(doc_id.as_py(), text.as_py())
        if shard.ids:
            yield pa.RecordBatch.from_pydict(shard.packed(n_docs, n_terms), _ARROW)

    return materialize(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(run, _INDEX), "index")


def frequencies(index: DataFrame, sent) -> dict[int, int]:
    """How many documents hold each of the sent terms, by its number; terms that none holds are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = sent.value["terms"], np.zeros(len(sent.value["terms"]), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                sizes = np.diff(np.frombuffer(starts.as_py(), "<u4").astype(np.int64))
                for k, t in enumerate(terms.as_py().split(b" ")):
                    if (at := wanted.get(t)) is not None:
                        total[at] += sizes[k]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "df": total[at]}, pa.schema([("term", pa.int64()), ("df", pa.int64())]))

    counted = index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in counted.collect()}  # at most the terms of one block of queries


class Best:
    """The k best documents so far: falling score, then rising id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.ids, self.no_id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        if len(score) > self.k:
            least = score[np.argpartition(score, len(score) - self.k)[len(score) - self.k :]].min()
            at = np.flatnonzero((score >= least) & (score > 0))  # all that share the k-th score, so that ids may choose among them
        else:
            at = np.flatnonzero(score > 0)
        if len(at) and len(self.score) == self.k:
            at = at[score[at] >= self.score[-1]]
        if len(at):
            score, ids, no_id = (np.concatenate(x) for x in ((self.score, score[at]), (self.ids, ids[at]), (self.no_id, no_id[at])))
            first = np.lexsort((ids, no_id, -score))[: self.k]
            self.score, self.ids, self.no_id = score[first], ids[first], no_id[first]


def scores(row: dict, queries: list[tuple[np.ndarray, np.ndarray]], wanted: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
    """The dense array of a shard's scores for each query that shares a term with it, term at a time."""
    starts, docs, impacts = np.frombuffer(row["starts"], "<u4"), np.frombuffer(row["docs"], "<u4" if row["n_docs"] > 65_536 else "<u2"), np.frombuffer(row["impacts"], "<u4").astype(np.int64)
    place = np.full(len(wanted), -1, np.int64)
    for k, t in enumerate(row["terms"].split(b" ")):
        if (at := wanted.get(t)) is not None:
            place[at] = k
    for q, (numbers, weights) in enumerate(queries):
        here = place[numbers] >= 0
        if here.any():
            total = np.zeros(row["n_docs"], np.int64)
            for t, w in zip(place[numbers[here]], weights[here]):
                a, b = starts[t], starts[t + 1]
                total[docs[a:b]] += w * impacts[a:b]  # a term has a document once
            yield q, total


def block_hits(index: DataFrame, sent, k: int) -> DataFrame:
    """Of each task the k best documents of each query of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = [Best(k) for _ in block["queries"]]
        for batch in batches:
            for row in batch.to_pylist():
                ids, no_id = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["no_id"], bool)
                for q, total in scores(row, block["queries"], block["terms"]):
                    best[q].add(total, ids, no_id)
        made = {"query": np.repeat(block["numbers"], [len(b.score) for b in best]), "doc_id": pa.array(np.concatenate([b.ids for b in best]), mask=np.concatenate([b.no_id for b in best])), "score": np.concatenate([b.score for b in best])}
        yield pa.RecordBatch.from_pydict(made, pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return index.mapInArrow(run, _FOUND)


def search(index: DataFrame, items: DataFrame, n_docs: int, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = index.sparkSession
    numbered = materialize(items.select(F.col(f"`{id_col}`").alias("item_id"), text_bytes(text_col).alias("text")).withColumn("query", F.monotonically_increasing_id()), "items")
    blocks, parts = max(1, -(-size_bytes(numbered, "text") // QUERY_BYTES)), []
    for b in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "text").collect()  # about QUERY_BYTES of text
        counted = [Counter(terms_of(bytes(r["text"]))) for r in rows]
        terms = {t: n for n, t in enumerate(dict.fromkeys(t for c in counted for t in c))}
        if not terms:
            continue
        asked = spark.sparkContext.broadcast({"terms": terms})
        weight = {n: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for n, df in frequencies(index, asked).items()}
        asked.destroy()
        queries = [[(terms[t], m * weight[terms[t]]) for t, m in c.items() if terms[t] in weight] for c in counted]
        arrays = [(np.array([n for n, _ in q], np.int64), np.array([w for _, w in q], np.int64)) for q in queries]
        sent = spark.sparkContext.broadcast({"terms": terms, "queries": arrays, "numbers": np.array([r["query"] for r in rows], np.int64)})
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        parts.append(materialize(block_hits(index, sent, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "hits"))
        sent.destroy()
    found = spark.createDataFrame([], _FOUND + ", rank int")
    for p in parts:
        found = found.unionByName(p)
    return found.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each item: an index of all documents, searched for all items."""
    n_docs, n_terms = totals(docs)
    index = build_index(docs, n_docs, n_terms)
    found = materialize(search(index, items, n_docs, k), "ranked")
    discard(index)
    return found
