"""Removal of repeated 200-byte strings by a sparse suffix array, merged from front-coded sorted runs.

Any 200-byte window has an anchor: the place of the least 32-byte hash in it. Equal windows have equal anchors at equal
distance, so only suffixes at anchors need sorting, about one in seventy. Neighbouring windows with one anchor are a segment.
Segments whose anchor's hash stands nowhere else are unique and end there. Equal segments (by a 64-bit hash of all their bytes)
are one class, however many documents hold them; a class found at two places is repeated as a whole. Of classes that share an
anchor's hash with others, one representative each is cut from its text: the suffix from the anchor and the bytes before it.
Each task sorts its suffixes and sends them front-coded, as length of the prefix shared with the one before and the rest. The
receiving task merges these runs with a loser tree that knows, for each candidate, how much it shares with the last suffix put
out, and compares only bytes beyond that. From the merged order's common prefixes and rolling hashes of the bytes before the
anchors it finds, for each distance of window and anchor, which windows are equal. Ranges of repeated windows go back to all
members of the class and from there to their texts.

An anchor's hash with more than ``group_limit`` classes is not merged in one task; the windows of those classes are hashed and
counted one by one, which gives the same ranges.

Texts are told apart by 64-bit hashes, as are segments; suffixes are compared byte by byte.

Defined cases: a null text is empty; texts under 200 bytes keep all. Repeated rows are documents of their own, so that all of
a repeated text of 200 bytes or more goes. Null ids are kept. An empty table gives an empty result. Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragrid.llm.common import discard, materialize, text_bytes

WINDOW, GRAM = 200, 32
_PLACE = np.uint64((1 << 24) - 1)
_LETTERS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes worked on at a time, below the reach of _PLACE.
_CHUNK = 256 << 10
_LONG = 8 << 20


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of the byte strings of length ``gram`` (a power of two) at each place of data."""
    h, base, n = _LETTERS[data], _BASE, 1
    while n < gram:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % (1 << 64), 2 * n
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def segments(data: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of windows that share their anchor, the place of the least hash in a window (the first of equals).

    data: texts one after another, of the given sizes. Returns for each run the number of its text, the place of its first
    window there, how many further windows it has, how far behind the first window its anchor is, and the anchor's hash."""
    ends = np.cumsum(sizes)
    if len(data) < window:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(np.uint64)
    h = gram_hashes(data, gram)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    n, width = 1, window - gram + 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < width:
        low = np.minimum(low[: len(low) - (width - n)], low[width - n :])
    at = (low & _PLACE).astype(np.int64)
    inside = np.zeros(len(at) + 1, np.int8)
    has = sizes >= window
    starts = (ends - sizes)[has]
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends[has] - window + 1, -1)
    valid = np.cumsum(inside[:-1]).astype(bool)
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = at[1:] != at[:-1]
    new[starts] = True
    new &= valid
    first = np.flatnonzero(new)
    edge = np.flatnonzero(new | ~valid)
    nxt = np.append(edge, len(at))[np.searchsorted(edge, first, side="right")]
    doc = np.searchsorted(ends, first, side="right")
    return doc, first - (ends - sizes)[doc], nxt - first - 1, at[first] - first, h[at[first]]


def _pieces(texts: list[bytes], window: int):
    """(texts' numbers, offsets, pieces) in chunks; a very long text is cut into pieces that overlap by a window less one byte."""
    numbers, offsets, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        if len(text) < window:
            continue
        for at in range(0, len(text) - window + 1, _LONG):
            part = text[at : at + _LONG + window - 1]
            numbers.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= _CHUNK:
                yield numbers, offsets, parts
                numbers, offsets, parts, size = [], [], [], 0
    if parts:
        yield numbers, offsets, parts


def anchors(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """h, s, key, id, p, more, lead: the segments of (key, id, text). more: further windows; lead: from the first window to the anchor."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            for numbers, offsets, parts in _pieces(bodies, window):
                data, sizes = b"".join(parts), np.array([len(x) for x in parts])
                doc, p, more, lead, h = segments(np.frombuffer(data, np.uint8), sizes, window, gram)
                start = (np.cumsum(sizes) - sizes)[doc] + p
                one = xxhash.xxh3_64_intdigest
                s = np.array([one(data[a:b]) for a, b in zip(start.tolist(), (start + more + window).tolist())], np.uint64)
                row = pa.array(np.array(numbers)[doc])
                at = (np.array(offsets, np.int64)[doc] + p).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x.astype(np.int32)) for x in (at, more, lead))], names=["h", "s", "key", "id", "p", "more", "lead"]
                )

    return texts.mapInArrow(run, f"h long, s long, key long, id {kind}, p int, more int, lead int")


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes at least."""
    n = min(len(a), len(b)) - known
    x = int.from_bytes(a[known : known + n]) ^ int.from_bytes(b[known : known + n])
    return known + n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Sorted strings as prefix lengths shared with the one before, and the rests."""
    shared = [0, *(_shared(a, b, 0) for a, b in zip(strings, strings[1:]))] if strings else []
    return np.array(shared, np.uint16), [s[n:] for s, n in zip(strings, shared)]


def merge(runs: list[tuple[list[int], list[bytes]]]) -> list[tuple[int, int, int]]:
    """Merges front-coded sorted runs of (shared lengths, rests): (run, place in it, prefix shared with the suffix put out before).

    The tree's inner nodes hold losers, each with the length it shares with the winner that it lost to. That winner passed
    all nodes up to the root, so that on its way up the next suffix of its run meets lengths that refer to the last
    output, as its own does. Longer shared prefix: the smaller string, without a look at it; equal: compare beyond it."""
    n = len(runs)
    strings: list[bytes | None] = [None] * n
    places, shares = [-1] * n, [0] * n

    def advance(r: int) -> None:
        places[r] += 1
        if places[r] == len(runs[r][0]):
            strings[r] = None
            return
        shares[r] = runs[r][0][places[r]]
        strings[r] = (strings[r] or b"")[: shares[r]] + runs[r][1][places[r]]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length then refers to the winner."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        k = _shared(x, y, shares[a])
        first = a if x[k : k + 1] < y[k : k + 1] or (x[k : k + 1] == y[k : k + 1] and a < b) else b
        second = b if first == a else a
        shares[second] = k
        return first, second

    for r in range(n):
        advance(r)
    size = 1
    while size < n:
        size *= 2
    losers = [-1] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size if node - size < n else -1
        a, b = build(2 * node), build(2 * node + 1)
        if a < 0 or b < 0:
            return max(a, b)
        winner, losers[node] = play(a, b)
        return winner

    out, winner = [], build(1) if n else -1
    while winner >= 0 and strings[winner] is not None:
        out.append((winner, places[winner], shares[winner]))
        node, r = (winner + size) // 2, winner
        advance(r)
        while node:
            if losers[node] >= 0:
                r, losers[node] = play(r, losers[node])
            node //= 2
        winner = r
    return out


def equal_windows(h: np.ndarray, s: np.ndarray, more: np.ndarray, lead: np.ndarray, shared: np.ndarray, before: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """(row, first, last): ranges of windows, counted from a segment's first, that another class holds too.

    Rows are in the order of their suffixes; shared: with the row before; before: the bytes from a segment's start to its anchor."""
    n, most = len(h), int(lead.max(initial=0))
    back = np.zeros((n, most), np.uint8)
    for k, x in enumerate(before):
        if x:
            back[k, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
    rolling, found = np.zeros(n, np.uint64), np.zeros((n, most + 2), bool)
    for j in range(most + 1):  # windows that begin j bytes before the anchor
        if j:
            rolling = rolling * np.uint64(_BASE) + _LETTERS[back[:, j - 1]]
        on = np.flatnonzero((lead - more <= j) & (j <= lead))
        if len(on) < 2:
            continue
        run = np.cumsum(shared < window - j)[on].astype(np.uint64)
        key = (rolling[on] ^ (run * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        found[on[order[1:][same]], j] = True
        found[on[order[:-1][same]], j] = True
    flat = np.diff(np.concatenate([np.zeros((n, 1), np.int8), found.astype(np.int8)], axis=1), axis=1)
    row, start = np.nonzero(flat == 1)
    _, stop = np.nonzero(flat == -1)
    return row, lead[row] - (stop - 1), lead[row] - start


def _sorted_runs(parts: int, window: int, run_rows: int):
    """Front-coded runs, one row for each receiving part, of the representatives that a task's texts hold."""

    def flush(rows: list[tuple]):
        rows.sort(key=lambda r: (r[0], r[1]))
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            shared, rests = front_code([r[1] for r in rows[at:to]])
            meta = np.array([r[3:] for r in rows[at:to]], np.int64)
            yield rows[at][0], shared.tobytes(), np.array(list(map(len, rests)), np.uint16).tobytes(), b"".join(rests), b"".join(r[2] for r in rows[at:to]), meta.tobytes()
            at = to

    def run(batches):
        def emit(rows):
            columns = list(zip(*flush(rows)))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["part", "shared", "sizes", "rests", "before", "meta"])

        rows: list[tuple] = []
        for batch in batches:
            for text, cuts in zip(batch.column(0), batch.column(1).to_pylist()):
                body = text.as_py()
                for c in cuts:
                    a = c["p"] + c["lead"]
                    rows.append((c["h"] % parts, body[a : a + window - c["lead"] + c["more"]], body[c["p"] : a], c["h"], c["s"], c["more"], c["lead"]))
                if len(rows) >= run_rows:
                    yield emit(rows)
                    rows = []
        if rows:
            yield emit(rows)

    return run


def _merge_part(window: int):
    def run(table: pa.Table) -> pa.Table:
        runs, metas, befores = [], [], []
        for r in table.to_pylist():
            shared, sizes = (np.frombuffer(r[c], np.uint16) for c in ("shared", "sizes"))
            ends = np.cumsum(sizes, dtype=np.int64)
            runs.append((shared.tolist(), [r["rests"][a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]))
            meta = np.frombuffer(r["meta"], np.int64).reshape(-1, 4)
            ends = np.cumsum(meta[:, 3])
            befores.append([r["before"][a:b] for a, b in zip((ends - meta[:, 3]).tolist(), ends.tolist())])
            metas.append(meta)
        order = merge(runs)
        first = np.cumsum([0, *map(len, metas)])
        meta = np.concatenate(metas)[[first[r] + k for r, k, _ in order]]
        shared, before = np.array([x for _, _, x in order]), [befores[r][k] for r, k, _ in order]
        row, low, high = equal_windows(*meta.T, shared, before, window)
        return pa.table({"h": meta[row, 0], "s": meta[row, 1], "first": low.astype(np.int32), "last": high.astype(np.int32)})

    return run


def _window_hashes(window: int):
    """(w, h, s, at): a hash of each window of each representative, for anchors with too many classes to merge in a task."""

    def run(batches):
        for batch in batches:
            for text, cuts in zip(batch.column(0), batch.column(1).to_pylist()):
                body = text.as_py()
                for c in cuts:
                    w = [xxhash.xxh3_64_intdigest(body[c["p"] + k : c["p"] + k + window]) for k in range(c["more"] + 1)]
                    n = len(w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(w, np.uint64).view(np.int64)), pa.array(np.full(n, c["h"])), pa.array(np.full(n, c["s"])), pa.array(np.arange(n, dtype=np.int32))], names=["w", "h", "s", "at"])

    return run


def _release(spark: SparkSession, *done: DataFrame) -> None:
    """Deletes tables that no later step reads, and lets Spark clear the shuffles of finished steps."""
    for df in done:
        discard(df)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_ranges(texts: DataFrame, window: int = WINDOW, group_limit: int = 200_000, part_rows: int = 20_000) -> DataFrame:
    """key, ranges: of each text (key, id, text) the ranges of places at which a window begins that begins elsewhere too."""
    spark = texts.sparkSession
    found = materialize(anchors(texts, window), "anchors")
    again = materialize(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    members = materialize(found.join(again, "h"), "members")
    _release(spark, found, again)

    place = F.struct("key", "p")
    classes = members.groupBy("h", "s").agg((F.min(place) != F.max(place)).alias("twice"), F.min(F.struct("key", "p", "id", "more", "lead")).alias("c"))
    classes = materialize(classes.select("h", "s", "twice", "c.*"), "classes")
    mixed = materialize(classes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "mixed")
    chosen = materialize(classes.join(mixed, "h").drop("twice"), "chosen")
    cuts = materialize(chosen.groupBy("key").agg(F.min("id").alias("id"), F.collect_list(F.struct("n", "h", "s", "p", "more", "lead")).alias("cuts")), "cuts")  # as long as the text allows
    held = texts.withColumnRenamed("id", "own").join(cuts, "key").where(F.col("own").eqNullSafe(F.col("id")))

    few = held.select("text", F.expr(f"filter(cuts, c -> c.n <= {group_limit})").alias("cuts"))
    parts = max(24, -(-chosen.count() // part_rows))
    runs = few.mapInArrow(_sorted_runs(parts, window, 100_000), "part int, shared binary, sizes binary, rests binary, before binary, meta binary")
    ranges = runs.groupBy("part").applyInArrow(_merge_part(window), "h long, s long, first int, last int")
    if not mixed.where(F.col("n") > group_limit).isEmpty():
        many = held.select("text", F.expr(f"filter(cuts, c -> c.n > {group_limit})").alias("cuts")).where(F.size("cuts") > 0)
        windows = materialize(many.mapInArrow(_window_hashes(window), "w long, h long, s long, at int"), "windows")
        equal = materialize(windows.groupBy("w").agg(F.min(F.struct("h", "s")).alias("a"), F.max(F.struct("h", "s")).alias("b")).where("a <> b").select("w"), "equal")
        ranges = ranges.unionByName(windows.join(equal, "w").select("h", "s", F.col("at").alias("first"), F.col("at").alias("last")))
    whole = classes.where("twice").select("h", "s", F.lit(0).alias("first"), F.col("more").alias("last"))
    hits = materialize(ranges.unionByName(whole), "hits")
    _release(spark, mixed, chosen, cuts, classes)
    size = F.max(F.length("text"))
    copied = texts.groupBy("key").agg(F.count("*").alias("n"), size.alias("size")).where(f"n > 1 and size >= {window}")
    copied = copied.select("key", F.struct(F.lit(0).alias("a"), (F.col("size") - window).cast("int").alias("b")).alias("r"))
    begun = members.join(hits, ["h", "s"]).select("key", F.struct((F.col("p") + F.col("first")).alias("a"), (F.col("p") + F.col("last")).alias("b")).alias("r"))
    out = materialize(begun.unionByName(copied).groupBy("key").agg(F.collect_set("r").alias("ranges")), "ranges")
    _release(spark, members, hits)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_limit: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every document."""
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.xxhash64(text_bytes(text_col)).alias("key"), F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    ranges = repeated_ranges(texts, window, group_limit)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, ranges in zip(batch.column(1), batch.column(2).to_pylist()):
            body, kept, at, spans = text.as_py(), [], 0, 0
            for r in sorted(ranges or (), key=lambda r: r["a"]):
                if r["a"] > at or not spans:
                    kept.append(body[at : r["a"]])
                    spans, at = spans + 1, max(at, r["a"])
                at = max(at, r["b"] + window)
            kept.append(body[at:])
            left = b"".join(kept)
            rows.append((len(body), len(body) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
        n, removed, spans, sha, left = zip(*rows) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string()), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = texts.join(ranges, "key", "left").select("id", "text", "ranges")
    return joined.mapInArrow(lambda batches: map(run, batches), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
