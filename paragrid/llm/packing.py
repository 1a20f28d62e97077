"""Best-fit packing of tokenized documents by exact-complement hashing.

Documents become pieces of at most ``size`` tokens. How pieces share sequences depends on lengths alone, so the
plan is made from the number of pieces of each length (at most ``size`` numbers, whatever the corpus): the
longest piece left opens a sequence; an index of single, pair and triple length sums is asked for what fills its
gap exactly under the counts left; if there is nothing, the longest piece that fits goes in and the index is
asked again. The combination found is used as often as its scarcest length allows, so that a plan has about as
many patterns as there are lengths. Pieces are then ranked within their length, over salted groups and group
offsets so that no length is sorted in one task, and look their rank up in the plan.

Defined cases: a null or empty text is one piece, the closing id alone. Repeated rows are pieces of their own,
null ids stay null. An empty table gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragrid.llm.common import materialize, text_bytes
from paragrid.llm.tokens import tokenizer


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, closing: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    end = np.array([closing], "<u4").tobytes()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        ids = tokenizer(vocabulary).ids
        for batch in batches:
            rows: list[tuple] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                got = ids(text) + end
                rows += [(row, k, at // 4, min(4 * size, len(got) - at) // 4, zlib.crc32(got[at : at + 4 * size])) for k, at in enumerate(range(0, len(got), 4 * size))]
            row, piece, start, length, crc = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return df.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Combinations of one, two or three lengths by their sum, under the counts of pieces left."""

    def __init__(self, left: np.ndarray):
        self.left, self.size, self.misses = left, len(left) - 1, 0
        self._index()

    def _index(self) -> None:
        """Sums that pairs have; counts only fall, so that an old index holds all that a new one would."""
        have = (self.left > 0).astype(np.float64)
        n = 2 * len(have)
        spectrum = np.fft.rfft(have, n)
        self.pairs, self.misses = np.fft.irfft(spectrum * spectrum, n)[: len(have)] > 0.5, 0

    def single(self, gap: int) -> tuple[int, ...]:
        return (gap,) if self.left[gap] else ()

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...]:
        """The pair with the longest first part (of at most ``most``) that fills a gap."""
        if gap < 2 or not self.pairs[gap]:
            return ()
        low, high = (gap + 1) // 2, min(gap - 1, most or gap)
        if high < low:
            return ()
        first = np.arange(high, low - 1, -1)
        need = np.where(first * 2 == gap, 2, 1)
        fits = np.flatnonzero((self.left[first] >= need) & (self.left[gap - first] >= need))
        if not len(fits):
            return ()
        return int(first[fits[0]]), int(gap - first[fits[0]])

    def triple(self, gap: int) -> tuple[int, ...]:
        firsts = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for a in firsts[(self.left[firsts] > 0) & self.pairs[gap - firsts]] if len(firsts) else ():
            self.left[a] -= 1
            rest = self.pair(gap - int(a), int(a))
            self.left[a] += 1
            if rest:
                return int(a), *rest
            self.misses += 1
            if self.misses > 256:
                self._index()
        return ()

    def exact(self, gap: int) -> tuple[int, ...]:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how many sequences have them) that use up the counts."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    sums, made = Sums(left), []
    longest = size
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return made
        before, inside, gap = left.copy(), [longest], size - longest
        left[longest] -= 1
        while gap:
            found = sums.exact(gap)
            if not found:
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                found = (int(fits[-1]) + 1,)
            inside += found
            gap -= sum(found)
            for x in found:
                left[x] -= 1
        used = np.bincount(inside, minlength=size + 1)
        at = np.flatnonzero(used)
        times = int((before[at] // used[at]).min())
        left[at] = before[at] - times * used[at]
        made.append((tuple(inside), times))


def slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """Runs of places by length and rank: the rank-th piece of a length lies in the run whose first rank is the last not above it."""
    taken = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for inside, times in patterns:
        offset = 0
        for length in inside:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(len(rows), 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def ranked(made: DataFrame, group_rows: int = 50_000) -> DataFrame:
    """made with rank: from 0 within each length."""
    salts = max(1, -(-made.count() // group_rows))
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    return local.join(before, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("before")).cast("long")).drop("salt", "before")


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, closing: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    made = materialize(pieces(df, vocabulary, id_col, text_col, size, closing), "pieces")
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most `size` rows
    places = df.sparkSession.sparkContext.broadcast(slots(plan(counts, size), size))  # about as many rows as patterns have parts

    def run(batches):
        p = places.value
        wide = np.int64(1) << np.int64(48)
        keys = p["length"] * wide + p["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * wide + rank, side="right") - 1
            sequence = p["sequence"][at] + rank - p["rank"][at]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(p["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked(made).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
