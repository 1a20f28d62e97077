"""Benchmark decontamination: a BM25 index of test items, block-max WAND over every passage, checked overlap.

The terms are pairs of neighbouring words (a word alone for an item of one word), lower-cased, with ASCII
punctuation as white space. A posting's impact is the term's BM25 weight in the item divided by the item's whole
BM25 weight, so that a passage's score for an item is the share of the item's weight that it holds, and one
threshold serves all items. Every passage of every document is a query. Items are kept in classes of length (up to 32, 64,
128 words and so on), each with an inverted index of its own; a class's passages are twice as long as its longest items may be and
overlap by half, so that each item lies whole in one. A passage whose upper bounds don't reach the threshold ends there; the
rest goes through block-max WAND over the stored postings and block maxima, which returns all items above the threshold. A hit
counts when the passage holds enough of the five-word shingles of both the item's question and its answer (the
last sentence, or the last quarter of the words where there is one sentence).

The index goes to every task. It is made of the items in shards of at most ``shard_bytes`` of text, one scan of the
documents for each, so that its size is bounded. Document frequencies, the number of items and their mean length are counted
over all items first, so that scores don't depend on shards.

Defined cases: null or empty texts hold nothing; null or empty items match nothing. Repeated items hit each,
repeated documents are each judged; item ids may be of any type. A score equal to the threshold is a hit. Without items no
document is a hit. A very long text is read as passages like any other. Further columns pass through ``keep_clean``;
names beginning with ``__d_`` are ours.
"""

from __future__ import annotations

import string
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragrid.llm.common import map_batches, materialize

_TABLE = bytes(32 if chr(b) in string.punctuation else b for b in range(256))
SHINGLE = 5


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's words, split before its last sentence."""
    parts = [w for x in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if (w := words_of(x))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def _shingles(words: list) -> set[tuple]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[k:] for k in range(SHINGLE)]))


def _overlap(part: list, passage: list) -> float:
    """The share of a part's shingles of words (or their numbers) that the passage holds; 1 for a part without words."""
    want = _shingles(part)
    if not want:
        return 1.0
    n = min(SHINGLE, len(part))
    have = set(zip(*[passage[k:] for k in range(n)]))
    return len(want & have) / len(want)


class Postings:
    """The lists of all terms, one after another: items by rising number with impacts; for each block of a list its
    greatest impact and its last item; for each list its greatest impact."""

    BLOCK = 64

    def __init__(self, term: np.ndarray, item: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        starts = np.searchsorted(term, np.arange(terms + 1))
        sizes = np.diff(starts)
        blocks = np.append(0, np.cumsum(-(-sizes // self.BLOCK)))
        block_term = np.repeat(np.arange(terms), np.diff(blocks))
        first = starts[block_term] + (np.arange(len(block_term)) - blocks[block_term]) * self.BLOCK
        last = np.minimum(first + self.BLOCK, starts[block_term + 1]) - 1
        most = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)
        self.most = np.maximum.reduceat(most, blocks[:-1]) if terms else np.zeros(0)
        self.items, self.impacts, self.starts = array("q", item.tolist()), array("d", impact.tolist()), array("q", starts.tolist())
        self.blocks, self.block_most, self.block_last = array("q", blocks.tolist()), array("d", most.tolist()), array("q", item[last].tolist() if len(first) else [])


class Cursor:
    END = 1 << 60

    def __init__(self, lists: Postings, term: int):
        self.p, self.start, self.end, self.most = lists, lists.starts[term], lists.starts[term + 1], float(lists.most[term])
        self.at, self.block, self.first_block, self.last_block = self.start, lists.blocks[term], lists.blocks[term], lists.blocks[term + 1]
        self.item = lists.items[self.at]

    def _block(self, item: int) -> int:
        """The first block from here on whose last item isn't below the given one."""
        k, last = max(self.block, self.first_block + (self.at - self.start) // Postings.BLOCK), self.p.block_last
        while k < self.last_block and last[k] < item:
            k += 1
        self.block = k
        return k

    def seek(self, item: int) -> None:
        """To the first posting whose item isn't below the given one; blocks before it are skipped by their last items."""
        k = self._block(item)
        if k == self.last_block:
            self.at, self.item = self.end, self.END
            return
        low = self.start + (k - self.first_block) * Postings.BLOCK
        self.at = bisect_left(self.p.items, item, max(self.at, low), min(low + Postings.BLOCK, self.end))
        self.item = self.p.items[self.at]

    def bound(self, item: int) -> tuple[float, int]:
        """The greatest impact in the block that would hold an item, and that block's last item."""
        k = self._block(item)
        return (self.p.block_most[k], self.p.block_last[k]) if k < self.last_block else (0.0, self.END - 1)


def block_max_wand(lists: Postings, terms: list[int], least: float) -> list[tuple[int, float]]:
    """(item, score) of all items whose impacts in the lists of the terms add up to at least the threshold."""
    cursors, found = [Cursor(lists, t) for t in terms], []
    while True:
        cursors = sorted((c for c in cursors if c.item < Cursor.END), key=lambda c: c.item)
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c.most
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            return found
        item = cursors[pivot].item
        while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
            pivot += 1
        bounds = [c.bound(item) for c in cursors[: pivot + 1]]
        if sum(b for b, _ in bounds) >= least:
            if cursors[0].item == item:
                score = sum(lists.impacts[c.at] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                for c in cursors[: pivot + 1]:
                    c.seek(item + 1)
            else:
                for c in cursors[:pivot]:
                    if c.item < item:
                        c.seek(item)
        else:
            to = min([last + 1 for _, last in bounds] + [c.item for c in cursors[pivot + 1 : pivot + 2]])
            for c in cursors[: pivot + 1]:
                c.seek(max(to, item + 1) if c.item == item else to)


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays])


class _Ids(dict):
    def __missing__(self, word):
        return 0


def terms_of(words: list[bytes]) -> list[bytes]:
    """An item's terms, repeats included."""
    return [a + b" " + b for a, b in zip(words, words[1:])] if len(words) > 1 else words


class Level:
    """The items of one class of length: their terms, as numbers of two words, and postings."""

    def __init__(self, numbers: list[np.ndarray], items: list[int], weights: list[tuple[np.ndarray, np.ndarray]], width: int, stride: int):
        self.stride, self.width = stride, width
        keys = np.concatenate([k for k, _ in weights])
        item = np.repeat(items, [len(k) for k, _ in weights])
        self.terms, term = np.unique(keys, return_inverse=True)
        self.alone = any(len(n) == 1 for n in numbers)
        self.lists = Postings(term, item, np.concatenate([w for _, w in weights]), len(self.terms))

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words at which a term begins, and the terms' numbers."""
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        keys = ids[at] * self.width + ids[at + 1]
        if self.alone:
            one = np.flatnonzero(ids)
            at, keys = np.concatenate([at, one]), np.concatenate([keys, ids[one]])
            order = np.argsort(at, kind="stable")
            at, keys = at[order], keys[order]
        k = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        hit = self.terms[k] == keys
        return at[hit], k[hit]

    def candidates(self, ids: np.ndarray, least: float):
        """(item, score, passage) of all items whose score in a passage of the text reaches the threshold."""
        at, terms = self.matches(ids)
        if not len(at):
            return
        part = at // self.stride
        bound = np.bincount(part, self.lists.most[terms], part.max() + 2)
        for k in np.flatnonzero(bound + np.append(bound[1:], 0) >= least).tolist():
            inside = set(terms[np.searchsorted(part, k) : np.searchsorted(part, k + 2)].tolist())
            passage = None
            for item, score in block_max_wand(self.lists, sorted(inside), least):
                passage = ids[k * self.stride : (k + 2) * self.stride].tolist() if passage is None else passage
                yield item, score, passage


class Index:
    """The items of one shard; hits() queries it with all passages of a text.

    items: (text, document frequency of each of its terms among all items); n: how many items there are in all, mean: their mean length in
    words. Postings and words are flat arrays of numbers, a few bytes for each word of the items, as every task holds a copy."""

    def __init__(self, items: list[tuple[str | None, dict[bytes, int]]], n: int, mean: float, least: float = 0.5, least_overlap: float = 0.8, k1: float = 1.2, b: float = 0.75):
        self.least, self.least_overlap = least - 1e-9, least_overlap
        kept = [(at, t, w, df) for at, (t, df) in enumerate(items) if t and (w := words_of(t))]
        self.rows, self.vocabulary = [at for at, _, _, _ in kept], _Ids()
        number = lambda words: np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)
        numbers = [number(words) for _, _, words, _ in kept]
        parts = [number(p) for _, t, _, _ in kept for p in question_answer(t)]
        self.part_ends, self.part_words = np.cumsum([0, *map(len, parts)]), _joined(parts).astype(np.int32)
        width = len(self.vocabulary) + 1
        classes: dict[int, list[int]] = {}
        weights = []
        for k, (_, _, words, dfs) in enumerate(kept):
            ids = numbers[k]
            keys, first, f = np.unique(ids[:-1] * width + ids[1:] if len(ids) > 1 else ids, return_index=True, return_counts=True)
            terms = terms_of(words)
            df = np.array([dfs[terms[j]] for j in first.tolist()], np.float64)
            weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(words) / mean))
            weights.append((keys, weight / weight.sum()))
            stride = 32
            while stride < len(words):
                stride *= 2
            classes.setdefault(stride, []).append(k)
        self.levels = [Level([numbers[k] for k in mine], mine, [weights[k] for k in mine], width, stride) for stride, mine in sorted(classes.items())]

    def part(self, k: int) -> list[int]:
        """The words' numbers of a question (2 * item) or an answer (2 * item + 1)."""
        return self.part_words[self.part_ends[k] : self.part_ends[k + 1]].tolist()

    def hits(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item's row, score, question overlap, answer overlap), the best passage of each item that a text holds."""
        words = words_of(text) if text and self.levels else []
        if not words:
            return []
        ids = np.array(list(map(self.vocabulary.__getitem__, words)), np.int64)  # 0: in no item
        best: dict[int, tuple[float, float, float]] = {}
        for level in self.levels:
            for i, score, passage in level.candidates(ids, self.least):
                question, answer = (_overlap(self.part(2 * i + p), passage) for p in (0, 1))
                if question >= self.least_overlap and answer >= self.least_overlap:
                    best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (score, question, answer))
        return [(self.rows[i], *v) for i, v in sorted(best.items())]


def _item_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, words, distinct terms) of each item."""
    words = [words_of(t) if t else [] for t in batch.column(1).to_pylist()]
    terms = [sorted(set(terms_of(w))) for w in words]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(terms, pa.list_(pa.binary()))], names=["key", "words", "terms"])


def shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_bytes: int = 16 << 20):
    """(index, item ids) of the items, each over at most about shard_bytes of text."""
    keyed = materialize(items.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "items")
    terms = materialize(map_batches(keyed.select("key", "text"), _item_terms, "key long, words long, terms array<binary>"), "terms")
    n, mean = terms.where("words > 0").agg(F.count("*"), F.avg("words")).first()
    each = terms.select("key", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    told = each.join(df, "term").groupBy("key").agg(F.collect_list(F.struct("term", "df")).alias("df"))  # as long as the item
    told = materialize(keyed.join(told, "key", "left"), "told")
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-2 * total // shard_bytes)) if total > shard_bytes else 1
    for k in range(count):
        table = told.where(F.pmod(F.xxhash64("key"), F.lit(count)) == k).select("id", "text", "df").toArrow().combine_chunks()  # bounded by shard_bytes
        rows = zip(table.column("text").to_pylist(), table.column("df").to_pylist())
        ids = table.column("id")
        yield Index([(text, {d["term"]: d["df"] for d in df or ()}) for text, df in rows], n, mean or 1.0), (ids.chunk(0) if ids.num_chunks else pa.array([], ids.type))


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of each test item found in each document."""
    kinds = df.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    out = None
    for made in shards(items, item_col, item_text_col, shard_bytes):
        shared = df.sparkSession.sparkContext.broadcast(made)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index, ids = shared.value
            rows = [(k, *hit) for k, text in enumerate(batch.column(1).to_pylist()) for hit in index.hits(text)]
            at, item, score, question, answer = zip(*rows) if rows else [()] * 5
            values = [batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(item, pa.int64())), *(pa.array(x, pa.float64()) for x in (score, question, answer))]
            return pa.RecordBatch.from_arrays(values, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = map_batches(df.select(F.col(id_col).alias("doc_id"), text_col), run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 16 << 20) -> DataFrame:
    """The rows of df that hold no test item."""
    at = df.columns.index(text_col)
    for made in shards(items, item_col, item_text_col, shard_bytes):
        shared = df.sparkSession.sparkContext.broadcast(made)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            return batch.filter(pa.array([not shared.value[0].hits(x) for x in batch.column(at).to_pylist()], pa.bool_()))

        df = map_batches(df, run, df.schema)
    return df
