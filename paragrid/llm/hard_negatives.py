"""Hard negatives from embeddings, by an orthogonal PCA rotation with bounded remainders.

Vectors become integers, floor(scale * x), and a score is an integer inner product. An orthogonal matrix, fitted by PCA on a bounded
sample (``SAMPLE_ROWS`` rows in hash order; any orthogonal matrix gives the same result, a good one only prunes more), turns all vectors,
so that few leading components hold most of a product. Blocks of anchors meet blocks of rows, one pair of blocks to a group; there the
products of leading components are summed stage by stage, and what is left of a product lies within the product of the two residual norms
plus the slack of rounding. A row whose upper bound stays below what the anchor already has for certain is discarded at once; the
survivors are scored again in integers, and only these scores order anything.

Positives are the first ``n_positives`` other rows of the anchor's label. For each of them the negatives are the first ``n_negatives`` rows
of other labels whose scores lie in the band ``low * p <= 100 * s <= high * p`` around the positive's score p; ties go to the smaller id.

No row is left out of any comparison: groups hold at most about ROWS rows and ANCHORS anchors, whatever the labels, and a vector that a
third of the rows share only makes ties, of which a group gives back no more than it may return.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors of unequal lengths count as
padded by zeros, an empty one as zeros. Repeated rows count each: a copy of the anchor is another row. A non-positive positive score p
makes a band that is empty (or {0}). Scores that could pass 64 bits raise ValueError. An empty table gives an empty result. Further columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragrid.llm.common import discard, materialize

#: Rows and anchors that one group holds, anchors compared at once, pairs verified at once, rows that the rotation is fitted on.
ROWS, ANCHORS, AT_ONCE, PAIRS, SAMPLE_ROWS = 16_384, 4_096, 128, 65_536, 4_096
_CANDIDATES = "anchor long, slot int, pid long, pscore long, id long, score long"


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """uid, id, label, v (whole numbers) of the rows that take part, written once so that uid stays."""
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull() & ~odd)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return materialize(kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), whole.alias("v")).withColumn("uid", F.monotonically_increasing_id()), "vectors")


def rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """An orthogonal matrix whose first columns are the leading components of a sample of at most SAMPLE_ROWS rows."""
    sample = rows.orderBy(F.xxhash64("id"), "uid").limit(SAMPLE_ROWS).select("v").toArrow()
    x = matrix(sample.column("v"), dims).astype(np.float64)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1] if len(x) else np.eye(dims)


def matrix(lists: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of int64, padded by zeros."""
    out = np.zeros((len(lists), dims), np.int64)
    at = 0
    for chunk in lists.chunks if isinstance(lists, pa.ChunkedArray) else [lists]:
        sizes = np.diff(chunk.offsets.to_numpy())
        row = np.repeat(np.arange(len(chunk)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[at + row, place] = chunk.flatten().to_numpy()
        at += len(chunk)
    return out


class Turned:
    """Integer vectors with their turned forms, norms, and norms of what lies behind each cut."""

    def __init__(self, v: np.ndarray, q: np.ndarray, cuts: list[int]):
        self.v, self.r = v, v.astype(np.float64) @ q
        square = np.cumsum((self.r**2)[:, ::-1], 1)[:, ::-1]
        self.norm = np.sqrt(square[:, 0]) if v.shape[1] else np.zeros(len(v))
        self.tail = {k: np.sqrt(square[:, k]) if k < v.shape[1] else np.zeros(len(v)) for k in cuts}

    def take(self, at: np.ndarray) -> Turned:
        made = object.__new__(Turned)
        made.v, made.r, made.norm, made.tail = self.v[at], self.r[at], self.norm[at], {k: x[at] for k, x in self.tail.items()}
        return made


def cuts_of(dims: int) -> list[int]:
    return sorted({max(1, dims // 4), max(1, dims // 2), max(1, dims)})


def nth_largest(x: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row; -inf where a row is shorter."""
    return np.partition(x, x.shape[1] - n, 1)[:, x.shape[1] - n] if x.shape[1] >= n else np.full(len(x), -np.inf)


def survivors(a: Turned, x: Turned, allowed: np.ndarray, lows: np.ndarray, highs: np.ndarray, n: int, cuts: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band (a column of lows and highs), the pairs (anchor, row) that may be among an anchor's n best scores in it.

    Partial products grow from cut to cut, over the rows only that some anchor still needs. A row is needed if its upper bound reaches both
    the band and the n-th best lower bound of rows that are in the band for certain, and its lower bound does not pass the band."""
    rows, partial, done = np.arange(len(x.v)), np.zeros(allowed.shape), 0
    alive = [allowed] * lows.shape[1]
    for k in cuts:
        partial = partial + a.r[:, done:k] @ x.r[rows, done:k].T
        slack = np.outer(a.tail[k], x.tail[k][rows]) + np.outer(a.norm, x.norm[rows]) * (1e-15 * (a.v.shape[1] + 8)) + 1e-6
        low, high, done = partial - slack, partial + slack, k
        for b in range(lows.shape[1]):
            floor, top = lows[:, b : b + 1], highs[:, b : b + 1]
            certain = np.where(alive[b] & (low >= floor) & (high <= top), low, -np.inf)
            need = np.maximum(nth_largest(certain, n)[:, None], floor)
            alive[b] = alive[b] & (high >= need) & (low <= top)
        used = np.flatnonzero(np.logical_or.reduce(alive).any(0))
        rows, partial, alive = rows[used], partial[:, used], [m[:, used] for m in alive]
    return [(i, rows[j]) for i, j in map(np.nonzero, alive)]


def products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs, some at a time."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), PAIRS):
        out[s : s + PAIRS] = np.einsum("ij,ij->i", a[i[s : s + PAIRS]], x[j[s : s + PAIRS]])
    return out


def first_of_each(who: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each who by falling score and rising id."""
    order = np.lexsort((ids, -score, who))
    sorted_who = who[order]
    start = np.searchsorted(sorted_who, sorted_who)
    return order[np.arange(len(order)) - start < n]


def compare(anchors: pa.Table, rows: pa.Table, q: np.ndarray, n: int, band: tuple[int, int] | None) -> pa.Table:
    """Candidates of one pair of blocks: the first n of an anchor's own label, or those of other labels in each of its bands."""
    empty = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("pid", pa.int64()), ("pscore", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    if not (len(anchors) and len(rows)):  # a pair of which one side has no rows
        return empty.empty_table()
    dims, found = len(q), []
    cuts = cuts_of(dims)
    a_all, x_all = Turned(matrix(anchors.column("v"), dims), q, cuts), Turned(matrix(rows.column("v"), dims), q, cuts)
    a_uid, a_label, x_uid, x_id, x_label = (t.column(c).to_numpy() for t, c in ((anchors, "uid"), (anchors, "label"), (rows, "uid"), (rows, "id"), (rows, "label")))
    wanted = anchors.column("positives").to_pylist() if band else None
    for start in range(0, len(a_uid), AT_ONCE):
        at = np.arange(start, min(start + AT_ONCE, len(a_uid)))
        a = a_all.take(at)
        same = a_label[at][:, None] == x_label[None, :]
        if band is None:
            allowed = same & (a_uid[at][:, None] != x_uid[None, :])
            lows, highs = np.full((len(at), 1), -np.inf), np.full((len(at), 1), np.inf)
        else:
            allowed, most = ~same, max((len(wanted[k]) for k in at), default=0)
            lows, highs = np.full((len(at), most), np.inf), np.full((len(at), most), -np.inf)
            for row, k in enumerate(at):
                for b, p in enumerate(wanted[k]):
                    lows[row, b], highs[row, b] = -(-band[0] * p["pscore"] // 100), band[1] * p["pscore"] // 100
        for b, (i, j) in enumerate(survivors(a, x_all, allowed, lows, highs, n, cuts)):
            score = products(a.v, x_all.v, i, j)
            inside = (score >= lows[i, b]) & (score <= highs[i, b])
            i, j, score = i[inside], j[inside], score[inside]
            best = first_of_each(i, score, x_id[j], n)
            i, j, score = i[best], j[best], score[best]
            owner = [wanted[at[k]][b] for k in i] if band else None
            found.append(pa.table({"anchor": a_uid[at[i]], "slot": pa.array(np.full(len(i), b), pa.int32()), "pid": pa.array([p["pid"] for p in owner] if band else np.zeros(len(i), np.int64), pa.int64()), "pscore": pa.array([p["pscore"] for p in owner] if band else np.zeros(len(i), np.int64), pa.int64()), "id": x_id[j], "score": score}))
    return pa.concat_tables(found).cast(empty) if found else empty.empty_table()


def meet(anchors: DataFrame, rows: DataFrame, shards: int, groups: int, q: np.ndarray, n: int, band: tuple[int, int] | None) -> DataFrame:
    """Candidates of all pairs of blocks: rows are dealt into shards and anchors into groups, and each pair meets in one task group."""
    of = lambda count, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = anchors.withColumn("group", of(groups, 1)).withColumn("shard", every(shards))
    fresh = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # both sides come from one table; a cogroup needs columns of their own
    right = fresh.withColumn("shard", of(shards, 2)).withColumn("group", every(groups))

    def run(a: pa.Table, x: pa.Table) -> pa.Table:
        return compare(a, x, q, n, band)

    return left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(run, _CANDIDATES)


def best(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is a condition on the column ``id``."""
    rows = usable(df, id_col, vector_col, label_col, scale)
    size = F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))))
    n_rows, dims, most, n_anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(size, F.lit(0)), F.count(F.when(is_anchor, 1))).first()
    dims = max(1, dims)
    if most < 0 or dims * most * most >= 2**63 or max(abs(low), abs(high), 100) * dims * most * most >= 2**63:
        raise ValueError("components so large that scores could pass 64 bits")
    q = rotation(rows, dims)
    shards = max(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // ROWS))
    groups = max(1, -(-n_anchors // ANCHORS))
    anchors = rows.where(is_anchor)
    bare = rows.select("uid", "id", "label", "v")
    positives = best(meet(anchors.select("uid", "label", "v"), bare, shards, groups, q, n_positives, None), ["anchor"], n_positives)
    listed = positives.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("pid"), F.col("score").alias("pscore")))).alias("positives"))
    full = materialize(anchors.join(listed, "uid"), "anchors")
    found = best(meet(full.select("uid", "label", "v", "positives"), bare, shards, groups, q, n_negatives, (low, high)), ["anchor", "slot"], n_negatives)
    made = materialize(found.join(full.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor_id", F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score")), "negatives")
    discard(full)
    discard(rows)
    return made
