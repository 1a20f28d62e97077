"""Line dedup: lines found in many documents go, by probing a sharded minimal perfect hash.

Documents are dealt into blocks by a hash of their id and text. Each block gives its distinct line hashes
with the number of its documents that hold them: a line common to all documents is one row per block. These
rows are kept as a table and dealt to shards by hash. A shard sums the counts of its distinct hashes and builds a minimal perfect hash
over them (levels of bit arrays with rank); an array of 32-bit fingerprints and an array of document counts stand at the
hash's numbers. The shards' arrays are written to the shared folder, a row for each.

Hot lines, those that an eighth of all blocks hold, are at most eight times as many as a block has distinct lines; their arrays go to all tasks,
where the documents probe them. The blocks' other hashes go to their shard's arrays and probe those, and what
reaches min_docs goes back to the blocks that hold it. No line text is shuffled or joined. Line keys are told apart by 64-bit XXH3 hashes.

Defined cases: a null or empty text is one empty line, which has an empty key and stays. Keys shorter than
min_chars stay. A repeated row counts as a document of its own; a line counts once per document. An empty
table gives an empty result. Further columns pass through ``drop_common_lines``; names beginning with
``__l_`` are ours.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragrid.llm.common import blocks_for, map_batches, materialize, size_bytes, text_bytes

_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    x = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: at each level, keys alone in their place are settled there."""

    def __init__(self, keys: np.ndarray, load: float = 1.5):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        rest, base, seed = keys, 0, 0
        while len(rest):
            size = max(1, int(len(rest) * load))
            at = (_mix(rest, seed) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, base + np.cumsum(alone) - alone, size))
            base += int(alone.sum())
            rest, seed = rest[~alone[at]], seed + 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number from 0 of each key; keys that weren't built in get some number or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for seed, (alone, rank, size) in enumerate(self.levels):
            at = (_mix(keys[rest], seed) % np.uint64(size)).astype(np.int64)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


class CountIndex:
    """Compact arrays of fingerprints and counts behind a perfect hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, print_bits: int = 32):
        self.hash, self.print_bits = PerfectHash(keys), print_bits
        at = self.hash(keys)
        self.prints, self.counts = np.zeros(len(keys), np.uint64 if print_bits > 32 else np.uint32), np.zeros(len(keys), np.uint32)
        self.prints[at], self.counts[at] = self._print(keys), np.minimum(counts, 2**32 - 1)

    def _print(self, keys: np.ndarray) -> np.ndarray:
        return _mix(keys, 1 << 20) if self.print_bits > 32 else (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys; 0 for a key that isn't in the index (with short fingerprints, but for one in 2**32 of those)."""
        if not len(self.prints):
            return np.zeros(len(keys), np.int64)
        at = self.hash(keys)
        return np.where((at >= 0) & (self.prints[at] == self._print(keys)), self.counts[at].astype(np.int64), 0)

    def arrays(self) -> tuple[list[int], bytes, bytes, bytes]:
        """(sizes of the levels, their bits, fingerprints, counts), for a row of a table."""
        bits = b"".join(np.packbits(alone).tobytes() for alone, _, _ in self.hash.levels)
        return [size for _, _, size in self.hash.levels], bits, self.prints.tobytes(), self.counts.tobytes()

    @classmethod
    def of(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes) -> CountIndex:
        """The index that arrays() told; fingerprints are of 32 bits."""
        made, at, base = cls(np.zeros(0, np.uint64), np.zeros(0)), 0, 0
        for size in sizes:
            n = -(-size // 8)
            alone = np.unpackbits(np.frombuffer(bits, np.uint8, n, at), count=size).astype(bool)
            made.hash.levels.append((alone, base + np.cumsum(alone) - alone, size))
            at, base = at + n, base + int(alone.sum())
        made.prints, made.counts = np.frombuffer(prints, np.uint32), np.frombuffer(counts, np.uint32)
        return made


def _block(df: DataFrame, text_col: str, blocks: int) -> DataFrame:
    """df with __l_block and the text as __l_text, dealt by block."""
    text = text_bytes(text_col)
    others = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    told = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != text_col and isinstance(f.dataType, T.AtomicType)]
    made = df.select(*others, text.alias("__l_text"), F.pmod(F.xxhash64(text, *told), F.lit(blocks)).cast("int").alias("__l_block"))
    return made.repartition(blocks, "__l_block")


def _line_counts(batches):
    """(block, line hash, documents) of what a task holds, a block at a time."""
    found: dict[int, Counter] = {}
    for batch in batches:
        for block, text in zip(batch.column("__l_block").to_pylist(), batch.column("__l_text").to_pylist()):
            keys = {k for x in text.split(b"\n") if (k := line_key(x))}
            found.setdefault(block, Counter()).update(keys_of(keys))
    for block, counter in found.items():
        n = len(counter)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block, np.int32)), pa.array(np.fromiter(counter.keys(), np.uint64, n).view(np.int64)), pa.array(np.fromiter(counter.values(), np.int64, n))], names=["block", "h", "n"]
        )


def keys_of(keys: set[bytes]) -> set[int]:
    return {xxhash.xxh3_64_intdigest(k) for k in keys}


_INDEX = "shard int, sizes array<long>, bits binary, prints binary, counts binary, hot binary, hot_counts binary"


def build(lines: DataFrame, shards: int, hot_blocks: int, min_docs: int) -> DataFrame:
    """The written index of (block, h, n): a row of arrays for each shard; hot: lines of min_docs documents that hot_blocks blocks hold."""

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        h, n, blocks = table.column("h").to_numpy().view(np.uint64), table.column("n").to_numpy(), table.column("blocks").to_numpy()
        hot = (blocks >= hot_blocks) & (n >= min_docs)
        sizes, bits, prints, counts = CountIndex(h, n).arrays()
        row = [key[0].as_py()], [sizes], [bits], [prints], [counts], [h[hot].tobytes()], [n[hot].tobytes()]
        kinds = pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5
        return pa.table([pa.array(x, k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in _INDEX.split(", ")])

    sums = lines.withColumn("shard", _shard_of(shards)).repartition(shards, "shard").groupBy("shard", "h").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"))
    return materialize(sums.groupBy("shard").applyInArrow(shard, _INDEX), "index")


def _shard_of(shards: int):
    return F.pmod(F.col("h"), F.lit(shards)).cast("int")


def common_lines(lines: DataFrame, index: DataFrame, hot: CountIndex, shards: int, min_docs: int) -> DataFrame:
    """(__l_block, h): for each block, the hashes of its lines that min_docs documents hold, without the hot ones."""
    shared = lines.sparkSession.sparkContext.broadcast(hot)

    def other(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.probe(batch.column("h").to_numpy().view(np.uint64)) == 0))

    def probe(table: pa.Table, arrays: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(["block", "h"]).rename_columns(["__l_block", "h"])
        saved = CountIndex.of(*(arrays.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts")))
        hit = saved.probe(table.column("h").to_numpy().view(np.uint64)) >= min_docs
        return table.filter(pa.array(hit)).select(["block", "h"]).rename_columns(["__l_block", "h"])

    rest = map_batches(lines.select("block", "h"), other, "block int, h long").withColumn("shard", _shard_of(shards))
    return rest.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, "__l_block int, h long")


def drop_common_lines(df: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of df with the kept text in place, and __l_lines, __l_dropped: lines before, and how many went.

    min_chars: keys of fewer code points stay."""
    blocks = blocks_for(size_bytes(df, text_col), block_bytes)
    blocked = _block(df, text_col, blocks)
    lines = materialize(blocked.mapInArrow(_line_counts, "block int, h long, n long"), "lines")
    index = build(lines, blocks, max(2, blocks // 8), min_docs)
    told = index.select("hot", "hot_counts").collect()  # eight times a block's distinct lines at most
    hot = CountIndex(*(np.concatenate([np.zeros(0, k), *(np.frombuffer(r[c], k) for r in told)]) for c, k in (("hot", np.uint64), ("hot_counts", np.int64))), print_bits=64)
    hits = common_lines(lines, index, hot, blocks, min_docs)
    shared = df.sparkSession.sparkContext.broadcast(hot)
    others = [c for c in df.columns if c != text_col]
    fields = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*fields, T.StructField(text_col, T.StringType()), T.StructField("__l_lines", T.LongType()), T.StructField("__l_dropped", T.LongType())])

    def rewrite(docs: pa.Table, hit: pa.Table) -> pa.Table:
        gone, index, cache = set(hit.column("h").to_numpy().tolist()), shared.value, {}

        texts, before, dropped = [], [], []
        for text in docs.column("__l_text").to_pylist():
            lines = text.split(b"\n")
            keys = [line_key(x) for x in lines]
            new = list({k for k in keys if k and k not in cache})
            if new:
                h = np.array([xxhash.xxh3_64_intdigest(k) for k in new], np.uint64)
                found = (index.probe(h) >= min_docs) | np.fromiter((x in gone for x in h.view(np.int64).tolist()), bool, len(h))
                cache.update(zip(new, found.tolist()))
            kept = [x for x, k in zip(lines, keys) if not (k and cache[k] and (min_chars < 2 or len(k.decode("utf-8", "replace")) >= min_chars))]
            texts.append(b"\n".join(kept))
            before.append(len(lines))
            dropped.append(len(lines) - len(kept))
            if len(cache) > 1 << 18:
                cache.clear()
        made = docs.select(others)
        for name, values in ((text_col, pa.array(texts, pa.binary()).cast(pa.string())), ("__l_lines", pa.array(before, pa.int64())), ("__l_dropped", pa.array(dropped, pa.int64()))):
            made = made.append_column(name, values)
        return made

    return blocked.groupBy("__l_block").cogroup(hits.groupBy("__l_block")).applyInArrow(rewrite, schema)
