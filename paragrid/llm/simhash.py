"""SimHash near-dedup with pigeonring filtering.

A fingerprint sums the bits of the XXH64 hashes of a text's word shingles. Two fingerprints link when at most
two bits differ. The 64 bits form a ring of five segments. If the differences over the ring add up to two at
most, there is a segment from which every chain of consecutive segments stays within its share of the budget:
none in one or two segments (0.4, 0.8), one in three or four (1.2, 1.6). So a fingerprint has a partner only if one of its
chains meets another fingerprint's: first by the two equal segments, then with the third that differs by a bit at most. Fingerprints that
meet none are pruned at each step. Chains are counted by key, never paired, so that the work is linear in any bucket.

The full Hamming check of what is left puts each fingerprint under itself and its 64 one-bit changes: two that differ
in two bits at most share such a key, all that share one link by way of it, and each is tied to the least. That is exact and
linear, whatever the number of near fingerprints. Components are then found over fingerprints.

Defined cases: a null or empty text has no words and fingerprint zero; a text of fewer words than a shingle
is one shingle. Repeated rows and ids each get a row. A null id stays null and never names a component unless
all ids in it are null. Further columns pass through ``keep_one``; names beginning with ``__s_`` are ours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragrid.llm.common import map_batches, materialize, text_bytes
from paragrid.llm.components import connected_components

SEGMENTS = (13, 13, 13, 13, 12)
DISTANCE = 2


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> bytes:
    """The eight bytes, highest first, of a UTF-8 text's fingerprint."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    one = xxhash.xxh64_digest
    if len(words) < shingle:
        return one(b" ".join(words), seed)
    h = b"".join([one(b" ".join(x), seed) for x in zip(*[words[k:] for k in range(shingle)])])
    n = len(h) // 8
    bits = np.unpackbits(np.frombuffer(h, np.uint8).reshape(n, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes()


def fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``keep`` and fp (long)."""
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "fp long"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = b"".join([fingerprint(x.as_py(), shingle) for x in batch.column(len(keep))])
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=[*keep, "fp"])

    return map_batches(df.select(*keep, text_bytes(text_col).alias("__s_text")), run, schema)


def _masks() -> list[int]:
    out, at = [], 64
    for n in SEGMENTS:
        at -= n
        out.append(((1 << n) - 1) << at)
    return out


def _lit(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _bits(mask: int) -> list[int]:
    return [1 << k for k in range(64) if mask >> k & 1]


def _meeting(fps: DataFrame) -> DataFrame:
    """The fingerprints fp one of whose chains over three segments meets that of another one."""
    masks, n = _masks(), len(SEGMENTS)
    two = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_lit(masks[i] | masks[(i + 1) % n])).alias("key")) for i in range(n)])
    keyed = fps.select("fp", F.inline(two))
    again = materialize(keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1").select("i", "key"), "chains")
    met = materialize(keyed.join(again, ["i", "key"]).select("fp", "i"), "met")

    def variants(i: int):
        """Chain i: its three segments, as they are and with each bit of the third changed."""
        own = F.col("fp").bitwiseAND(_lit(masks[i] | masks[(i + 1) % n] | masks[(i + 2) % n]))
        flips = F.array(_lit(0), *[_lit(b) for b in _bits(masks[(i + 2) % n])])
        return F.transform(flips, lambda flip: F.struct(own.bitwiseXOR(flip).alias("key"), (flip == 0).cast("int").alias("own")))

    third = variants(0)
    for i in range(1, n):
        third = F.when(F.col("i") == i, variants(i)).otherwise(third)
    chains = met.select("fp", "i", F.inline(third))
    shared = materialize(chains.groupBy("i", "key").agg(F.count("*").alias("n"), F.sum("own").alias("own")).where("n > 1 and own > 0").select("i", "key"), "shared")
    return chains.join(shared, ["i", "key"], "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp: enough of them to connect all that differ in at most two bits."""
    left = materialize(_meeting(fps), "left")
    flips = F.array(F.lit(0).cast("long"), *[_lit(1 << k) for k in range(64)])
    around = left.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = around.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("near", "a")
    return around.join(least, "near").where("fp <> a").select("a", F.col("fp").alias("b"))


def components(told: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """fp, component_id: each distinct fingerprint with the smallest id reachable. told: (id, fp) read from files."""
    fps = materialize(told.groupBy("fp").agg(F.min(id_col).alias("id")), "fps")
    roots = materialize(connected_components(links(fps.select("fp"))), "roots")
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    ids = named.select("fp", "root").join(least, "root").select("fp", "least")
    return materialize(fps.join(ids, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id")), "classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id for every row."""
    told = materialize(fingerprints(df, [id_col], text_col, shingle), "fingerprints")
    classes = components(told, id_col)
    return told.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of df with one document of each component: that with the smallest id (nulls last), and of rows with
    the same id and text any one."""
    keys = df.withColumn("__s_h", F.xxhash64(text_col))
    told = materialize(fingerprints(keys, [id_col, "__s_h"], text_col, shingle), "fingerprints")
    classes = components(told, id_col)
    of = told.join(classes, "fp").select(F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull().alias("c0"), F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("__s_h")).alias("k"))
    kept = materialize(of.groupBy("c", "c0").agg(F.min("k").alias("k")).select(F.col(f"k.{id_col}").alias("__s_id"), F.col("k.__s_h").alias("__s_k")).distinct(), "kept")
    out = keys.join(kept, F.col(id_col).eqNullSafe(F.col("__s_id")) & (F.col("__s_h") == F.col("__s_k")), "left_semi")
    again = told.groupBy(id_col, "__s_h").count().where("count > 1")
    if not again.isEmpty():
        out = out.dropDuplicates([id_col, "__s_h"])
    return out.drop("__s_h")
