"""Quality of whole texts: random-indexing word vectors, pooled per document, and a two-layer network with a calibrated temperature.

Tokens are runs of letters, digits and characters beyond ASCII, or runs of other visible characters; case is kept. Their hashes choose one of
``slots`` rows (2 to the 15th; words that share a row share a vector, at every size of the corpus alike). Each slot has a sparse index vector
of NONZERO entries of +1 or -1, drawn from a seed, and a slot's word vector is the sum of the index vectors of the two neighbours on either
side of each of its occurrences in all texts. Each task adds these up in whole numbers and Spark sums the tasks', so the vectors hold all
documents and depend on no order. The pools of a text, the mean of its tokens' unit vectors, one in which frequent slots weigh less, and the
mean products of vectors one, two and three tokens apart, go into a network of one tanh layer and a logit. It is trained on at most ``train_rows`` labelled documents (in hash order of their ids; the
bound of the fit, all else covers all texts), its temperature on the fifth of these that training does not see.

Sent to tasks are the vectors (slots x dims floats, 6 MB, whatever the corpus) and the network. Equal rows in other files or another order
give equal scores: sums are whole numbers, and a document's floats are added in the order of its tokens.

Defined cases: a null or empty text has a zero pool and gets the network's score of that. Repeated rows count each, and a row's label is the
largest of its id's labels that are not null; null ids have none. Without labels of both kinds to train on, the score is (good + 1) / (labels + 2)
everywhere. An empty table gives an empty result. Only the named columns are read; names of ours begin with ``__c_``. Ties: score = 0.3 is
predicted 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragrid.llm.common import materialize, text_bytes

SLOT_BITS, DIMS, NONZERO, SEED, TRAIN_ROWS = 15, 48, 4, 20_011, 20_000
#: Texts are worked on in stretches of about so many bytes.
STRETCH = 1 << 20
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 2e-3, 1e-4
#: A slot with this share of all tokens weighs half in the second pool.
COMMON = 1e-3
#: How far apart the tokens are whose vectors' products are pooled.
LAGS = (1, 2, 3)
_CLASS = np.array([0 if c in b" \t\n\x0b\x0c\r" else 1 if chr(c).isascii() and chr(c).isalnum() or c >= 0x80 else 2 for c in range(256)], np.uint8)
_VALUE = np.where(_CLASS > 0, np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1), np.uint64(0))
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the tokens of texts that lie one behind the other in data, and each token's text."""
    kind = _CLASS[data]
    before = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = 0
    starts = np.flatnonzero((kind > 0) & (kind != before))
    if not len(starts):
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    value = _VALUE[data[starts[0] :]] * _POWER[place & 63]
    h = np.add.reduceat(value, starts - starts[0])
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.uint16), np.searchsorted(offsets, starts, "right") - 1


def stretches(column: pa.BinaryArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, behind the last, bytes and offsets of runs of texts of about STRETCH bytes; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    group = np.cumsum(lengths) // STRETCH if len(lengths) else lengths
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(lengths)] if len(lengths) else [0]
    for a, b in zip(cuts, cuts[1:]):
        data = np.frombuffer(b"".join(x or b"" for x in column[int(a) : int(b)].to_pylist()), np.uint8)
        yield int(a), int(b), data, np.concatenate([[0], np.cumsum(lengths[a:b])])


def index_vectors(slots: int = 1 << SLOT_BITS, dims: int = DIMS) -> np.ndarray:
    """A sparse vector of +1 and -1 for each slot, and zeros behind the last for the gap between texts."""
    rng, made = np.random.default_rng(SEED), np.zeros((slots + 1, dims), np.int8)
    place = np.argsort(rng.random((slots, dims)), 1)[:, :NONZERO]
    np.put_along_axis(made[:slots], place, rng.choice(np.array([-1, 1], np.int8), (slots, NONZERO)), 1)
    return made


def add_contexts(total: np.ndarray, count: np.ndarray, slots: np.ndarray, text: np.ndarray, index: np.ndarray) -> None:
    """Adds to each slot of total the index vectors of the two tokens on either side of its occurrences."""
    if not len(slots):
        return
    gap = len(index) - 1
    at = np.arange(len(slots)) + 2 * (1 + np.concatenate([[0], np.cumsum(np.diff(text) > 0)]))
    seq = np.full(at[-1] + 3, gap, np.uint16)
    seq[at] = slots
    near = index[seq]
    context = near[at - 2] + near[at - 1] + near[at + 1] + near[at + 2]
    order = np.argsort(slots, kind="stable")
    ordered = slots[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total[ordered[first]] += np.add.reduceat(context[order], first, axis=0, dtype=np.int64)
    count[ordered[first]] += np.diff(np.append(first, len(ordered)))


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Context sums (slots x DIMS) and counts of all texts; their size is fixed by the parameters."""
    size, names = 1 << SLOT_BITS, [f"v{k}" for k in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total, count = index_vectors(), np.zeros((size, DIMS), np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in stretches(batch.column(0)):
                add_contexts(total, count, *tokens(data, offsets), index)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at]), *(pa.array(total[at, k]) for k in range(DIMS))], names=["slot", "n", *names])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ["slot", "n", *names]])
    summed = docs.select(text_bytes(text_col).alias("__c_text")).mapInArrow(run, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).toArrow()
    total, count = np.zeros((size, DIMS), np.int64), np.zeros(size, np.int64)
    at = summed.column("slot").to_numpy()
    count[at] = summed.column("n").to_numpy()
    for k, c in enumerate(names):
        total[at, k] = summed.column(c).to_numpy()
    return total, count


def pool_table(total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the slots, and their weights in the second pool."""
    norm = np.sqrt((total.astype(np.float64) ** 2).sum(1))
    return (total / np.maximum(norm, 1)[:, None]).astype(np.float32), COMMON / (COMMON + count / max(1, count.sum()))


def pools(column: pa.BinaryArray, unit: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The pools of each text, one row for each: the mean vector, the weighted mean, and for each lag the mean product of two tokens' vectors so far apart."""
    dims = unit.shape[1]
    out = np.zeros((len(column), dims * (2 + len(LAGS))))
    for a, _, data, offsets in stretches(column):
        slots, text = tokens(data, offsets)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(slots) else []
        for s in range(0, len(first), 64):  # few texts at once: the tokens' vectors are not held for all
            lo, hi = first[s], first[s + 64] if s + 64 < len(first) else len(slots)
            starts, rows = first[s : s + 64] - lo, a + text[first[s : s + 64]]
            here, each, w = text[lo:hi], unit[slots[lo:hi]], weight[slots[lo:hi]]
            size = np.diff(np.append(starts, hi - lo))[:, None]
            out[rows, :dims] = np.add.reduceat(each, starts, axis=0, dtype=np.float64) / size
            out[rows, dims : 2 * dims] = np.add.reduceat(each * w[:, None], starts, axis=0, dtype=np.float64) / np.add.reduceat(w, starts)[:, None]
            for k, lag in enumerate(LAGS, 2):
                both = np.zeros_like(each)
                pair = here[lag:] == here[:-lag]
                both[lag:] = each[lag:] * each[:-lag] * pair[:, None]
                out[rows, k * dims : (k + 1) * dims] = np.add.reduceat(both, starts, axis=0, dtype=np.float64) / np.maximum(size - lag, 1)
    return out


class Network:
    """One tanh layer and a logit over standardized inputs, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.rate = (y.sum() + 1) / (len(y) + 2)
        self.fitted = 0 < y[~held].sum() < (~held).sum()
        if not self.fitted:
            return
        rng, train_x, train_y = np.random.default_rng(SEED), x[~held], y[~held]
        self.mean, self.std = train_x.mean(0), train_x.std(0) + 1e-6
        self.w = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        z, step, m, v = (train_x - self.mean) / self.std, 0, [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for s in range(0, len(z), BATCH):
                at, step = order[s : s + BATCH], step + 1
                h = np.tanh(z[at] @ self.w[0] + self.w[1])
                error = (_sigmoid(h @ self.w[2] + self.w[3]) - train_y[at]) / len(at)
                back = np.outer(error, self.w[2]) * (1 - h**2)
                for k, g in enumerate([z[at].T @ back + DECAY * self.w[0], back.sum(0), h.T @ error + DECAY * self.w[2], np.array([error.sum()])]):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = _temperature(self.logits(x[held]), y[held]) if held.any() else 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """einsum adds in one order whatever the number of rows."""
        h = np.tanh(np.einsum("ij,jk->ik", (x - self.mean) / self.std, self.w[0]) + self.w[1])
        return np.einsum("ij,j->i", h, self.w[2]) + self.w[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature) if self.fitted else np.full(len(x), self.rate)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(x / 2)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm; at least 1/4, at most 50."""
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y > 0, -logits, logits) / np.exp(t)))
    a, b, g = np.log(0.25), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, labels: DataFrame, table, id_col: str, text_col: str, label_col: str, may_learn: Column, train_rows: int) -> Network:
    """A network from at most train_rows labelled documents; ``may_learn`` is a condition on the labels' ids."""
    key = F.xxhash64(F.col("__c_id").cast("string"))
    known = labels.select(F.col(f"`{id_col}`").alias("__c_id"), F.col(f"`{label_col}`").cast("int").alias("__c_y"), may_learn.alias("__c_ok")).where("__c_ok and __c_y is not null and __c_id is not null")
    chosen = known.groupBy("__c_id").agg(F.max("__c_y").alias("__c_y")).orderBy(key, "__c_id").limit(train_rows)  # few: the side that is sent out
    rows = docs.select(F.col(f"`{id_col}`").alias("__c_id"), text_bytes(text_col).alias("__c_text")).join(F.broadcast(chosen), "__c_id").select(key.alias("key"), "__c_y", "__c_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pooled = pools(batch.column(2), *table.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in pooled], pa.binary())], names=["key", "y", "x"])

    found = rows.mapInArrow(run, "key long, y int, x binary").orderBy("key", "x", "y").limit(train_rows).toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float64).reshape(len(found), -1) if len(found) else np.zeros((0, (2 + len(LAGS)) * DIMS))
    y, k = found.column("y").to_numpy().astype(np.float64), found.column("key").to_numpy()
    return Network(x, (y > 0).astype(np.float64), k % 5 == 0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", may_learn: Column | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id and score (0 to 1, higher where a label of 1 is likelier) of every row of docs."""
    context = docs.sparkSession.sparkContext
    table = context.broadcast(pool_table(*word_vectors(docs, text_col)))
    network = train(docs, labels, table, id_col, text_col, label_col, F.lit(True) if may_learn is None else may_learn, train_rows)
    source = docs.select(F.col(f"`{id_col}`"), text_bytes(text_col).alias("__c_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = network.probabilities(pools(batch.column(1), *table.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=[id_col, "score"])

    scored = materialize(source.mapInArrow(run, T.StructType([source.schema.fields[0], T.StructField("score", T.DoubleType())])), "quality")
    table.destroy()
    return scored
