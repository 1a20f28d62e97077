"""Quality rules per document, and verdicts on whole hosts from shrunk failure rates.

Each document's base measures decide whether it fails by itself. Besides, further rules count failures per
host (the ``source`` of a document); a host's failure rate is shrunk by a beta prior fitted by moments over
all hosts, and a host is rejected with all its documents when the lower bound of its posterior rate passes a
threshold. Host tallies are sums made before the shuffle, so a host with a third of all rows costs no more.

Defined cases: a null or empty text has no words and fails (fewer than min_words). A null host is a host of
its own. Repeated rows count each. An empty table gives an empty result. Further columns pass through
``keep_good``; names beginning with ``__q_`` are ours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragrid.llm.common import map_batches, materialize, text_bytes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
WINDOW = 5
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_MULT = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window that is found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * _MULT + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, _SPACE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_measures(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of df (all by default) and a struct ``__q_m`` of the measures."""
    names = df.columns if carry is None else carry
    source = df.select(*[F.col(f"`{c}`") for c in names], text_bytes(text_col).alias("__q_text"))
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__q_m", kind)])
    arrow = pa.struct([pa.field(m, pa.int64()) for m in MEASURES])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(x.as_py()) for x in batch.column(len(names))]
        columns = zip(*rows) if rows else [[] for _ in MEASURES]
        made = pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], fields=list(arrow))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], made], names=[*names, "__q_m"])

    return map_batches(source, run, schema)


def base_failed(m: Column, min_words: int = 10, most_repeat: int = 20) -> Column:
    return (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > most_repeat * m["n_words"])


def rule_failed(m: Column) -> Column:
    """The rules counted per host: the base rules, or many symbols, or mostly repeated lines, or odd word lengths."""
    return base_failed(m) | (10 * m["n_symbols"] > m["n_words"]) | (2 * m["n_dup_lines"] > m["n_lines"]) | (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])


def host_verdicts(measured: DataFrame, host_col: str, most_failed: float = 0.5, z: float = 1.645) -> DataFrame:
    """__q_host, __q_rejected: hosts by the lower bound of their shrunk failure rate."""
    hosts = measured.groupBy(F.col(f"`{host_col}`").alias("__q_host")).agg(F.count("*").alias("n"), F.sum(rule_failed(F.col("__q_m")).cast("long")).alias("bad"))
    mean = F.sum("bad") / F.sum("n")
    top = hosts.agg(mean.alias("mean"), F.count("*").alias("groups"), F.sum("n").alias("total"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("square"))
    inside = F.col("mean") * (1 - F.col("mean"))
    spread = (F.col("square") - F.col("total") * F.col("mean") * F.col("mean") - F.col("groups") * inside) / F.col("total")
    prior = top.select("mean", F.greatest(F.lit(1.0), F.least(F.lit(1000.0), inside / F.greatest(spread, F.lit(1e-6)) - 1)).alias("k"))
    rate = (F.col("bad") + F.col("k") * F.col("mean")) / (F.col("n") + F.col("k"))
    low = rate - z * F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("k") + 1))
    return hosts.crossJoin(F.broadcast(prior)).select("__q_host", (low > most_failed).alias("__q_rejected"))  # prior is one row


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source", most_failed: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of df (all by default; the host's is one of them), the struct ``__q_m``, and ``__q_kept``. Texts are measured once."""
    measured = materialize(with_measures(df, text_col, carry), "measured")
    hosts = host_verdicts(measured, host_col, most_failed)
    joined = measured.join(hosts, F.col(f"`{host_col}`").eqNullSafe(F.col("__q_host")), "left")
    return joined.withColumn("__q_kept", ~base_failed(F.col("__q_m")) & ~F.col("__q_rejected")).drop("__q_host", "__q_rejected")


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of df that neither fail by themselves nor belong to a rejected host."""
    return judge(df, text_col, host_col).where("__q_kept").drop("__q_m", "__q_kept")
