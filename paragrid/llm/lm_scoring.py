"""Language-model scores by online logistic context mixing, and add-one unigram scores beside them.

The model codes a text as the bytes of its tokens (words, then one end), each with a blank behind it, and a byte as the bits of a fixed prefix code. Each bit of each
token, known or new, is predicted. Three predictors give it counts of zeros and ones under a hashed context of the running text: the word so far; that with the
last short word (up to three bytes) before; the last two bytes of the word with that short word. Their stretched predictions are added under weights that
a gate picks (the place in the word, and how often the context was seen), and the sum is refined by an adaptive map. Weights
and maps go on learning while a text is read, each text from the same trained state. A token that training didn't have is, at a rate that follows the text, spelled
from its end instead, with predictors over the two, three and four bytes after and weights of their own; its probability is the sum of both ways. No token is
weighed by its count. ``total_bits`` is the text's cost, ``bits_per_byte`` that by its bytes.

Training reads all training documents once, online: each task predicts the bits of a batch of tokens from what it has counted so far, corrects weights and
map, then counts. Equal tokens after equal short words have equal contexts; in a batch they are one row with their number, as are the bytes of those that begin
alike, of the tokens between two corrections and within a turn of a text that is scored. The
spelling model learns in the same way from all tokens that occur once. The tasks' counts travel in a byte each (large ones apart) and are summed, their weights and maps meet in a mean weighed by use, in whole
numbers. Texts are dealt to learners and blocks by hash and read in the order of ids and texts, whatever files they came from, so that equal rows in other files or another order give equal scores.
Counts of running text have 2**20 slots for each predictor at every size of the corpus: contexts that meet in a slot share it. Spelling tables have 2**bits slots for each order,
more as the vocabulary grows, 2**21 at most. Both are sent to all tasks (19 MB). Token counts, for the base score and for what is new, grow without bound: they are shuffled by token, and go back to the blocks of documents that hold the token.

A training document is scored as if the bit at hand had not been counted at its place, so that its score and that of a held-out one are on one scale. Counts from 64 on are
kept in steps of a twelfth of their logarithm.

Defined cases: a null or empty text is one end token. A null id counts as the empty string for the fold. Repeated rows
count each time. Without training documents all counts are 0 and tokens are spelled at a bit a bit. An empty table
gives an empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paragrid.llm.common import blocks_for, materialize, size_bytes, text_bytes

#: Predictors of a bit of running text and of a spelling's bit; levels of how often a context was seen; bytes of the word in the third context.
ORDERS, LEVELS, NEAR = 3, 5, 2
#: Places of bits that have weights of their own: by the bytes of the word so far. Slots of each order's counts in running text.
PLACES, SLOT_BITS = 8, 20
SLOTS = 1 << SLOT_BITS
#: Points of the adaptive map, over stretched probabilities from -12 to 12.
POINTS, REACH = 33, 12.0
#: Tokens whose equal cells are one row: in training at first and at most. Tokens that are read between two corrections: in training (cells); in a text at first and at most.
TRAIN_STEPS, TRAIN_CELLS, STEPS = (4096, 1 << 18), 2048, (32, 1024)
#: Tokens of different texts that are mixed together, so that their bits fit a processor's cache.
PIECE = 2000
#: So many bytes at most are sorted with their places in the low bits of their hashes.
FEW = 1 << 16
#: How fast weights and maps learn: in training, within a text.
RATES, MAP_RATES = (0.5, 0.02), (0.02, 0.02)
_UNIT = float(1 << 20)
_RANGE = 1 << 15
_SPELLINGS = [f"spelling {k}" for k in range(ORDERS)]
_COUNTS = {"class", *_SPELLINGS}
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
_LEVEL_OF = np.digitize(np.arange(17), (0.5, 1.5, 3.5, 15.5)).astype(np.int64)


def tokens_of(text: bytes) -> list[bytes]:
    out = text.lower().split()
    out.append(b"")
    return out


def _level(n: np.ndarray) -> np.ndarray:
    """How often a context was seen: not, once, twice or thrice, less than sixteen times, more often."""
    return _LEVEL_OF.take(np.minimum(n, 16).astype(np.int64))


def _stir(h: np.ndarray) -> np.ndarray:
    h = h * _D
    return h ^ (h >> np.uint64(32))


def _stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.1)) / (zeros + np.float32(0.1))).astype(np.float32)


def _byte_code() -> tuple[np.ndarray, ...]:
    """A prefix code of bytes: bits of each byte, where they begin in the lists, and the lists of nodes (by depth, so that common ones lie together) and of bits.

    It is fixed. Bytes that are common in European texts have fewer bits, which saves steps; what a bit costs is the predictors' matter."""
    weight = np.full(256, 0.5)
    weight[128:192], weight[48:58], weight[list(b"'\"()!?:;-%&*$#|")] = 14, 10, 20
    weight[list(b"etaoinshrdlucmfwypvbgkqjxz")] = [1259, 770, 575, 493, 876, 524, 314, 654, 484, 264, 225, 237, 145, 50, 75, 69, 63, 45, 40, 101, 101, 30, 30, 8, 28, 36]
    weight[[32, 195, 46, 44, 169]] = 1545, 248, 130, 91, 64
    heap = [(w, k, (k,)) for k, w in enumerate(weight)]
    heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        (v, _, left), (w, _, right) = heappop(heap), heappop(heap)
        for bit, under in ((0, left), (1, right)):
            for k in under:
                paths[k].append((node, bit))
        heappush(heap, (v + w, 256 + node, left + right))
    size = np.array([len(x) for x in paths])
    depth = {node: d for x in paths for d, (node, _) in enumerate(reversed(x))}
    rank = {node: k for k, node in enumerate(sorted(depth, key=lambda node: (depth[node], -node)))}
    nodes, bits = zip(*(step for x in paths for step in reversed(x)))
    return size, np.cumsum(size) - size, np.array([rank[x] for x in nodes]), np.array(bits, np.int64)


_SIZE, _FROM, _NODE, _BIT = _byte_code()
#: By length of the code and byte: the nodes and the bits of the bytes with codes of that length; and the numbers of all lengths.
_NODES, _BITS = ([np.stack([x[np.minimum(_FROM + d, len(x) - 1)] for d in range(n)], axis=1) if n else x[:0] for n in range(int(_SIZE.max()) + 1)] for x in (_NODE, _BIT))
_LONG = _SIZE.astype(np.uint8)
assert len(_NODES) <= 16, "a length has four bits in Places.alike()"


def _bits_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the byte, index into the lists of the code) of the bits of bytes."""
    size = _SIZE.take(data)
    of = np.repeat(np.arange(len(data)), size)
    return of, np.arange(len(of)) + np.repeat(_FROM.take(data) - (np.cumsum(size) - size), size)


class Bits:
    """The bits of bytes that stand by the lengths of their codes: those of one length are a table, so that what bits of a byte share needs no index by bit."""

    def __init__(self, data: np.ndarray):
        counts = np.bincount(_LONG.take(data), minlength=len(_NODES))
        self.cuts, a, at = [], 0, 0
        for n in np.flatnonzero(counts).tolist():
            b = a + int(counts[n])
            self.cuts.append((a, b, n, at, at := at + (b - a) * n))
            a = b
        self.node, self.bit = np.empty(at, np.int64), np.empty(at, np.int64)
        for a, b, n, c, d in self.cuts:
            _NODES[n].take(data[a:b], axis=0, out=self.node[c:d].reshape(-1, n), mode="clip")
            _BITS[n].take(data[a:b], axis=0, out=self.bit[c:d].reshape(-1, n), mode="clip")

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the bytes for each bit."""
        out = np.empty(len(self.bit), values.dtype)
        for a, b, n, c, d in self.cuts:
            out[c:d].reshape(-1, n)[:] = values[a:b, None]
        return out

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums of the bits' values for each byte."""
        return np.concatenate([np.zeros(0), *(np.einsum("ij->i", values[c:d].reshape(-1, n)) for _, _, n, c, d in self.cuts)])


class Words:
    """Tokens as their bytes, each with a blank behind it."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.data = np.frombuffer(b" ".join([*tokens, b""]), np.uint8)
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.starts = self.ends - self.sizes

    def places(self) -> np.ndarray:
        """How many bytes of its token stand before each byte."""
        return np.arange(len(self.data)) - np.repeat(self.starts, self.sizes + 1)


class Places:
    """The bytes of tokens in running text with their contexts: the word so far; that and the last short word; the last bytes of the word and that short word."""

    def __init__(self, tokens: list[bytes], lead: np.ndarray):
        words = Words(tokens)
        self.data, self.inside, self.long = words.data, words.places(), words.sizes + 1
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(self.long.max(initial=1)), _A)]))
        self.wide = np.append(np.zeros(NEAR, np.uint64), self.data + np.uint64(1))
        own = self.wide[NEAR:] * power.take(self.inside)
        sums = np.append(np.uint64(0), np.cumsum(own))
        self.upto = sums[1:] - np.repeat(sums.take(words.starts), self.long)
        self.before = self.upto - own
        self.lead = np.repeat(_stir(lead), self.long)

    def alike(self, apart: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(an order by length of the bytes' codes in which those with equal short word, word so far and byte stand together, the first one first; where these groups start).

        apart: by byte, keeps groups apart. A 60-bit hash tells them, less the bits of the places of few bytes, which are then sorted along with it."""
        n = len(self.data)
        keys = (_stir((_stir(self.upto) ^ self.lead) * _A ^ apart) >> np.uint64(4)) | (_LONG.take(self.data).astype(np.uint64) << np.uint64(60))
        if n > FEW:
            order = np.argsort(keys, kind="stable")
            keys = keys.take(order)
        else:
            low = np.uint64((1 << n.bit_length()) - 1)
            keys = (keys & ~low) | np.arange(n, dtype=np.uint64)
            keys.sort()
            order = (keys & low).view(np.int64)
            keys |= low
        return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:n])

    def contexts(self, at: np.ndarray) -> list[np.ndarray]:
        """The slots, by order, where the contexts of some of the bytes begin; that of a bit is this one xor the bit's node."""
        lead, inside, so_far = self.lead.take(at), self.inside.take(at), _stir(self.before.take(at))
        near = lead
        for k in range(1, NEAR + 1):
            near = (near + np.where(inside >= k, self.wide.take(at + (NEAR - k)), np.uint64(0))) * _B
        return [(h >> np.uint64(64 - SLOT_BITS)).view(np.int64) for h in (so_far, _stir(so_far ^ lead), _stir(near))]


class Reading:
    """Some texts as tokens, each with its text, its place there, and the last short word before it."""

    def __init__(self, texts: list[list[bytes]]):
        self.tokens = list(chain.from_iterable(texts))
        n, sizes = len(self.tokens), np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.doc, at = np.repeat(np.arange(len(texts)), sizes), np.arange(n)
        self.place = at - first
        self.words = np.fromiter(map(crc32, self.tokens), np.uint64, n)
        lengths = np.fromiter(map(len, self.tokens), np.int64, n)
        last = np.maximum.accumulate(np.where((lengths > 0) & (lengths < 4), at, -1)) if n else at
        last = np.append(-1, last[:-1]) if n else last
        self.lead = np.where(last >= first, self.words[last] + np.uint64(1), np.uint64(0)) if n else self.words

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(the first token of each cell, tokens by cell): equal tokens after equal short words."""
        _, at, n = np.unique(_stir((_stir(self.lead) ^ self.words) * _A), return_index=True, return_counts=True)
        order = np.argsort(at)
        return at[order], n[order]

    def bits(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(byte of each bit; number of each byte's token among the given ones; bit; place of each byte in the word; slots by order) of some tokens, in their order."""
        places = Places([self.tokens[k] for k in at.tolist()], self.lead[at])
        of, k = _bits_of(places.data)
        slots = np.stack([h.take(of) ^ _NODE.take(k) for h in places.contexts(np.arange(len(places.data)))])
        return of, np.repeat(np.arange(len(at)), places.long), _BIT.take(k), np.minimum(places.inside, PLACES - 1), slots


class Mixer:
    """Weights by gate and the adaptive map of one kind of bits: for one reader, or for each of several texts from the same start."""

    def __init__(self, places: int, start: list[np.ndarray] | None = None, copies: int = 1):
        if start is None:
            line = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, POINTS)))
            start = [np.full((places * LEVELS, ORDERS), 0.4), np.tile(line, (LEVELS, 1))]
        self.weights, self.map = (np.tile(x.astype(np.float32), (copies, 1)) for x in start)
        self.used = [np.zeros(len(self.weights)), np.zeros(self.map.shape)]

    def step(self, x: np.ndarray, bit: np.ndarray, gate: np.ndarray, state: np.ndarray, rates: tuple[float, float] | None, n: np.ndarray | None = None, asked: bool = True) -> np.ndarray | None:
        """The bits' probabilities, if asked; rates: weights and map learn from them. x: inputs by bit; n: how often each bit occurs."""
        bit = bit.astype(np.float32)
        mixed = x[0] * self.weights[:, 0].take(gate)
        for k in range(1, ORDERS):
            mixed += x[k] * self.weights[:, k].take(gate)
        np.clip(mixed, -REACH, REACH, out=mixed)
        p = np.exp(-mixed)
        p += np.float32(1)
        np.reciprocal(p, out=p)
        at = mixed
        at += np.float32(REACH)
        at *= np.float32((POINTS - 1) / (2 * REACH))
        low = np.minimum(at, np.float32(POINTS - 1.001)).astype(np.int64)
        at -= low.astype(np.float32)
        cell = state * POINTS
        cell += low
        refined = self.map.ravel().take(cell)
        refined += (self.map.ravel()[1:].take(cell) - refined) * at
        q = np.clip((p + refined) * np.float32(0.5), np.float32(1e-6), np.float32(1 - 1e-6)) if asked else None
        if rates:
            error, off = bit - p, np.subtract(bit, refined, out=refined)
            if n is not None:
                error *= n
                off *= n
            seen = np.bincount(gate, n, len(self.weights))
            scale = rates[0] / np.maximum(seen, 8)
            for k in range(ORDERS):
                self.weights[:, k] += scale * np.bincount(gate, error * x[k], len(self.weights))
            cell += at >= 0.5  # the closer of two points learns
            mass = np.bincount(cell, n, self.map.size)
            self.map += (np.bincount(cell, off, self.map.size) * rates[1] / np.maximum(1, rates[1] * mass)).reshape(self.map.shape)
            if n is not None:
                self.used[0] += seen
                self.used[1] += mass.reshape(self.map.shape)
        return np.abs(q + bit - 1) if asked else None

    def told(self) -> bytes:
        """Weights and map times use, and use."""
        n = np.concatenate([np.repeat(self.used[0], ORDERS), self.used[1].ravel()]).astype(np.int64)
        v = np.concatenate([self.weights.ravel(), self.map.ravel()]).astype(np.float64)
        return np.concatenate([np.rint(v * _UNIT).astype(np.int64) * n, n]).tobytes()

    def merged(self, sums: np.ndarray | None) -> list[np.ndarray]:
        """The mean of what several told; what none used stays as it is here."""
        if sums is None:
            return [self.weights, self.map]
        v, n = sums.reshape(2, -1)
        flat = np.where(n > 0, v / np.maximum(n, 1) / _UNIT, np.concatenate([self.weights.ravel(), self.map.ravel()]))
        return [flat[: self.weights.size].reshape(self.weights.shape), flat[self.weights.size :].reshape(self.map.shape)]


class ClassLearner:
    """Reads the bits of training texts online, and classes contexts by how they went on: predicts bits from those counted so far, corrects itself, counts them."""

    def __init__(self):
        self.counts, self.mixer = np.zeros((ORDERS, SLOTS, 2), np.int32), Mixer(PLACES)
        self.waiting: list[list[bytes]] = []
        self.size, self.step = 0, TRAIN_STEPS[0]

    def read(self, tokens: list[bytes]) -> None:
        self.waiting.append(tokens)
        self.size += len(tokens)
        if self.size >= self.step:
            self.flush()
            self.step = min(2 * self.step, TRAIN_STEPS[1])

    def flush(self) -> None:
        if not self.waiting:
            return
        reading = Reading(self.waiting)
        self.waiting, self.size = [], 0
        cells, times = reading.cells()
        for a in range(0, len(cells), TRAIN_CELLS):
            some = cells[a : a + TRAIN_CELLS]
            places = Places([reading.tokens[k] for k in some.tolist()], reading.lead.take(some))
            order, starts = places.alike()  # words that begin alike after equal short words share those bits
            times_of = np.add.reduceat(np.repeat(times[a : a + TRAIN_CELLS], places.long).take(order), starts).astype(np.int32)
            at = order.take(starts)
            bits = Bits(places.data.take(at))
            n, x = bits.spread(times_of), np.empty((ORDERS, len(bits.bit)), np.float32)
            for k, h in enumerate(places.contexts(at)):
                s = bits.spread(h) ^ bits.node
                pair = self.counts[k].view(np.int64).reshape(-1).take(s).view(np.int32).astype(np.float32).reshape(-1, 2)
                if k == 1:
                    level = _level(pair[:, 0] + pair[:, 1])
                pair += np.float32(0.1)
                np.log(np.divide(pair[:, 1], pair[:, 0], out=x[k]), out=x[k])
                s *= 2
                s += bits.bit
                np.add.at(self.counts[k].reshape(-1), s, n)
            gate = bits.spread(np.minimum(places.inside.take(at), PLACES - 1) * LEVELS)
            self.mixer.step(x, bits.bit, gate + level, level, RATES, n.astype(np.float32), asked=False)


def spelling(tokens: list[bytes], table_bits: int) -> tuple[Bits, np.ndarray, list[np.ndarray], np.ndarray]:
    """(bits of the bytes of tokens, last byte first, and of a blank at the end; token's number of each byte; slots of each bit by order; place of each bit)."""
    words, lead = Words([t[::-1] for t in tokens]), 4
    place, order = words.places(), np.argsort(_LONG.take(words.data), kind="stable")
    data = np.append(np.zeros(lead, np.uint64), words.data.astype(np.uint64))
    h, bits, slots = np.full(len(words.data), _B), Bits(words.data.take(order)), []
    salt, shift = (bits.node + 1).astype(np.uint64) * _C, np.uint64(64 - table_bits)
    for k in range(1, lead + 1):
        byte = np.where(place >= k, data[lead - k : len(data) - k], np.uint64(0))
        h = (h ^ (byte * _D)) * _B
        h ^= h >> np.uint64(29)
        if k > 1:
            slots.append((((bits.spread(h.take(order)) ^ salt) * _D) >> shift).view(np.int64))
    return bits, np.repeat(np.arange(len(tokens)), words.sizes + 1).take(order), slots, bits.spread(np.minimum(place, PLACES - 1).take(order))


class SpellingLearner:
    """Reads tokens online, each once: predicts its bits from those counted so far, corrects itself, counts them."""

    def __init__(self, table_bits: int):
        self.table_bits, self.mixer = table_bits, Mixer(PLACES)
        self.counts = np.zeros((ORDERS, 2 << table_bits), np.float32)  # zeros and ones of a slot side by side

    def read(self, tokens: list[bytes], step: int = 512) -> None:
        for at in range(0, len(tokens), step):
            bits, _, slots, place = spelling(tokens[at : at + step], self.table_bits)
            bit, x = bits.bit, np.empty((ORDERS, len(bits.bit)), np.float32)
            for k, s in enumerate(slots):
                counts, s = self.counts[k], 2 * s
                zeros, ones = counts.take(s), counts.take(s + 1)
                x[k] = _stretch(zeros, ones)
                if k == 1:
                    level = _level(zeros + ones)
                np.add.at(counts, s + bit, np.float32(1))
            self.mixer.step(x, bit, place * LEVELS + level, level, RATES, np.ones(len(bit), np.float32), asked=False)


def _code_of(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: small ones as they are, others in steps of a twelfth."""
    return np.where(n < 64, n, np.minimum(64 + np.rint(12 * np.log(np.maximum(n, 64) / 64)), 255)).astype(np.uint16)


def packed(row: np.ndarray) -> np.ndarray:
    """Pairs of counts, zeros and ones, in two bytes."""
    pair = _code_of(row.reshape(-1, 2))
    return pair[:, 0] * np.uint16(256) + pair[:, 1]


@dataclass
class Model:
    """What scoring needs: counts of running text by context, plain or packed, packed counts of spellings, trained weights and maps, and counts of tokens."""

    class_counts: np.ndarray
    class_start: list[np.ndarray]
    spelling_counts: np.ndarray
    spelling_start: list[np.ndarray]
    table_bits: int
    total: int
    types: int
    singles: int

    def made(self) -> dict:
        """Tables that follow from the counts, made once in each worker."""
        if not hasattr(self, "_made"):
            code = np.arange(256)
            number = np.where(code < 64, code, 64 * np.exp((code - 64) / 12))
            zeros, ones = np.repeat(number, 256), np.tile(number, 256)
            zeros, ones = np.concatenate([zeros, zeros, np.maximum(zeros - 1, 0)]), np.concatenate([ones, np.maximum(ones - 1, 0), ones])
            self._made = {"packed": self.class_counts if self.class_counts.ndim == 2 else np.stack([packed(x) for x in self.class_counts]), "stretched": _stretch(zeros, ones), "level": _level(zeros + ones)}
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def spell(self, tokens: list[bytes], own: np.ndarray) -> np.ndarray:
        """The natural logarithms of tokens' spellings; own: 1 for a token that was learnt from, which is left out, else 0."""
        made, out = self.made(), [np.zeros(0)]
        mixer = Mixer(PLACES, self.spelling_start)
        for a in range(0, len(tokens), 1024):
            bits, number, slots, place = spelling(tokens[a : a + 1024], self.table_bits)
            bit, x = bits.bit, np.empty((ORDERS, len(bits.bit)), np.float32)
            less = bits.spread((own[a : a + 1024] << 16).take(number)) * (2 - bit)
            for k, s in enumerate(slots):
                n = less + self.spelling_counts[k].take(s)
                made["stretched"].take(n, out=x[k], mode="clip")
                if k == 1:
                    level = made["level"].take(n)
            cost = bits.totals(np.log(mixer.step(x, bit, place * LEVELS + level, level, None)))
            out.append(np.bincount(number, cost, len(tokens[a : a + 1024])))
        return np.concatenate(out)

    def log_probabilities(self, texts: list[list[bytes]], counts: list[np.ndarray], own: np.ndarray) -> np.ndarray:
        """The natural logarithm of each text's probability.

        counts: how often each token of a text was counted; own: 1 for a text among the counted ones, which is left out, else 0."""
        made, reading = self.made(), Reading(texts)
        c, doc, place = np.concatenate([np.zeros(0, np.int64), *counts]), reading.doc, reading.place
        mine = own[doc]
        left = np.maximum(c - mine, 0)
        new = left == 0
        expected = min(max(self.singles / max(self.total, 1), 1e-4), 0.95) if self.total else 0.95  # a token is new as often as one occurs once
        met = np.cumsum(new) - new
        share = np.clip((8 * expected + met - met[np.arange(len(c)) - place]) / (8 + place), 1e-4, 0.95) / 4  # new ones of this text so far; running text spells most of them too
        cost = np.log1p(-share) + self.running(reading, len(texts), own)
        at = np.flatnonzero(new)
        keys = list(zip([reading.tokens[k] for k in at.tolist()], (mine[at] * (c[at] == 1)).tolist()))  # learnt from: what occurs once
        distinct = sorted(set(keys))
        spelled = dict(zip(distinct, self.spell([t for t, _ in distinct], np.array([o for _, o in distinct], np.int64)).tolist()))
        cost[at] = np.logaddexp(cost[at], np.log(share[at]) + [spelled[k] for k in keys])
        return np.bincount(doc, cost, len(texts)).astype(np.float64)

    def running(self, reading: Reading, texts: int, own: np.ndarray) -> np.ndarray:
        """The natural logarithms of the tokens' probabilities, all bits predicted in running text."""
        made, place = self.made(), reading.place
        early = np.int64(STEPS[0]) << np.arange(1, 1 + int(math.log2(STEPS[1] // STEPS[0])))
        turn = np.searchsorted(early, place, side="right") + np.maximum(place - int(early[-1]), 0) // STEPS[1]
        by_turn, out = np.argsort(turn, kind="stable"), np.zeros(len(place))
        turn, doc = turn.take(by_turn), reading.doc.take(by_turn)
        starts = np.flatnonzero(np.append(True, (np.diff(turn) != 0) | (np.diff(doc) != 0)))[: len(turn)]  # of texts' turns, some of which are mixed together
        near = np.append(True, (np.diff(turn.take(starts)) != 0) | (np.diff(starts // PIECE) != 0))[: len(starts)]
        cuts = np.append(starts[near], len(turn))
        apart, mixer = _stir(reading.doc.astype(np.uint64) * _B), Mixer(PLACES, self.class_start, texts)
        for a, b in zip(cuts, cuts[1:]):
            some = by_turn[a:b]
            places = Places([reading.tokens[k] for k in some.tolist()], reading.lead.take(some))
            order, starts = places.alike(np.repeat(apart.take(some), places.long))  # words of a text that begin alike after equal short words share those bits
            at, times = order.take(starts), np.diff(starts, append=len(order))
            token = np.repeat(np.arange(b - a), places.long)
            bits, doc = Bits(places.data.take(at)), reading.doc.take(some).take(token.take(at))
            x, less = np.empty((ORDERS, len(bits.bit)), np.float32), bits.spread(own.take(doc) << 16)
            less *= 2 - bits.bit
            for k, h in enumerate(places.contexts(at)):
                h = bits.spread(h)
                h ^= bits.node
                n = made["packed"][k].take(h)
                np.add(less, n, out=h)
                made["stretched"].take(h, out=x[k], mode="clip")
                if k == 1:
                    level = made["level"].take(h)
            gate = bits.spread((doc * PLACES + np.minimum(places.inside.take(at), PLACES - 1)) * LEVELS)
            gate += level
            level += bits.spread(doc * LEVELS)
            cost = np.empty(len(order))
            cost[order] = np.repeat(bits.totals(np.log(mixer.step(x, bits.bit, gate, level, MAP_RATES, bits.spread(times.astype(np.float32))))), times)
            out[some] = np.bincount(token, cost, b - a)
        return out


def _train_flag(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


#: What tasks tell: tokens of a block with their counts in its training texts, or numbers that are summed by (kind, part).
_LEARNT = "kind string, part int, data binary, block int, token binary, n long"
_NAMES = [x.split()[0] for x in _LEARNT.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]


def _number(kind: str, part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int32()), pa.array([data], pa.binary()), *(pa.nulls(1, k) for k in _KINDS[3:])], names=_NAMES)


def _bytes_of(row: np.ndarray) -> bytes:
    """Counts of a range, one byte each up to 254; larger ones follow as places and what is above 255."""
    at = np.flatnonzero(row >= 255)
    return np.minimum(row, 255).astype(np.uint8).tobytes() + at.astype(np.uint16).tobytes() + (row[at] - 255).astype(np.int64).tobytes()


def _add_bytes(total: np.ndarray, data: bytes) -> None:
    """Adds what _bytes_of() gave to a range of counts."""
    total += np.frombuffer(data, np.uint8, _RANGE)
    n = (len(data) - _RANGE) // 10
    total[np.frombuffer(data, np.uint16, n, _RANGE)] += np.frombuffer(data, np.int64, n, _RANGE + 2 * n)


def _ranges(kind: str, row: np.ndarray):
    """A row of counts in ranges, one batch each."""
    for at in range(0, len(row), _RANGE):
        cut = row[at : at + _RANGE].astype(np.int64)
        if cut.any():
            yield _number(kind, at // _RANGE, _bytes_of(cut))


def _counted(block: int, counter: Counter):
    items = iter(counter.items())
    while some := list(islice(items, 10_000)):
        n, (tokens, counts) = len(some), zip(*some)
        none = [pa.nulls(n, k) for k in _KINDS[:3]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(np.full(n, block, np.int32)), pa.array(tokens, pa.binary()), pa.array(counts, pa.int64())], names=_NAMES)


def _learn(batches):
    """The tokens of each block that a task holds, block by block, and what its training texts tell of classes."""
    learner, now, counter = ClassLearner(), None, Counter()
    for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
        for train, text, block in zip(*[batch.column(c).to_pylist() for c in ("train", "text", "block")]):
            if block != now:
                yield from _counted(now, counter)
                now, counter = block, Counter()
            tokens = tokens_of(text)
            if train:
                counter.update(tokens)
                learner.read(tokens)
            else:
                counter.update(dict.fromkeys(tokens, 0))
    yield from _counted(now, counter)
    learner.flush()
    yield from _ranges("class", learner.counts.reshape(-1))
    yield _number("class mixer", 0, learner.mixer.told())


def _learn_spellings(table_bits: int):
    """What the tokens of each part tell of spellings."""

    def tell(learner: SpellingLearner):
        for k in range(ORDERS):
            yield from _ranges(_SPELLINGS[k], learner.counts[k])
        yield _number("spelling mixer", 0, learner.mixer.told())

    def run(batches):
        learner, now = None, None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if learner is None or parts[a] != now:
                    if learner is not None:
                        yield from tell(learner)
                    learner, now = SpellingLearner(table_bits), parts[a]
                learner.read(batch.column(1)[a:b].to_pylist())
        if learner is not None:
            yield from tell(learner)

    return run


def _total(table: pa.Table) -> np.ndarray:
    """The sum of the numbers of a group."""
    rows = (x.as_py() for x in table.column("data"))
    if table.column("kind")[0].as_py().endswith("mixer"):
        return sum(np.frombuffer(x, np.int64) for x in rows)
    total = np.zeros(_RANGE, np.int64)
    for x in rows:
        _add_bytes(total, x)
    return total


def _told(table: pa.Table, data: bytes) -> pa.Table:
    return pa.table([table.column("kind")[:1], table.column("part")[:1], pa.array([data], pa.binary())], names=["kind", "part", "data"])


def _summed(table: pa.Table) -> pa.Table:
    total = _total(table)
    return _told(table, total.tobytes() if table.column("kind")[0].as_py().endswith("mixer") else _bytes_of(total))


def _summed_last(table: pa.Table) -> pa.Table:
    """As the driver takes it: pairs of counts packed."""
    total = _total(table)
    return _told(table, (packed(total) if table.column("kind")[0].as_py() in _COUNTS else total).tobytes())


def _sums(learnt: DataFrame) -> dict[str, dict[int, np.ndarray]]:
    """What tasks told, summed by kind and part, in two steps so that no group holds more than a 64th of the tasks; of bounded size."""
    told, schema = learnt.where("kind is not null").select("kind", "part", "data", F.pmod(F.xxhash64("data"), F.lit(64)).alias("salt")), "kind string, part int, data binary"
    sums: dict[str, dict[int, np.ndarray]] = {}
    for r in told.groupBy("kind", "part", "salt").applyInArrow(_summed, schema).groupBy("kind", "part").applyInArrow(_summed_last, schema).collect():
        sums.setdefault(r["kind"], {})[r["part"]] = np.frombuffer(r["data"], np.uint16 if r["kind"] in _COUNTS else np.int64)
    return sums


def _whole(parts: dict[int, np.ndarray] | None, size: int, step: int = _RANGE, kind: type = np.int64) -> np.ndarray:
    out = np.zeros(size, kind)
    for part, row in (parts or {}).items():
        out[part * step : part * step + len(row)] = row
    return out


def table_bits_for(singles: int, most: int = 21) -> int:
    """Slots of each order: about sixteen for each token to learn spellings from."""
    return min(most, max(16, math.ceil(math.log2(max(singles, 1))) + 4))


def fit(learnt: DataFrame, told: DataFrame) -> Model:
    """The model of what tasks learnt and of all tokens (token, c, first: one row of each token)."""
    total, types, single = told.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    bits = table_bits_for(single)
    learners = max(1, min(12, single // 20_000), single >> 24)  # each sends its tables, and reads its tokens in the order of their hashes
    order = F.xxhash64("token")
    singles = told.where("first and c = 1").select(F.pmod(order, F.lit(learners)).cast("int").alias("learner"), "token")
    spelled = materialize(singles.repartitionById(learners, "learner").sortWithinPartitions("learner", order, "token").mapInArrow(_learn_spellings(bits), _LEARNT), "spelled")
    classes, spellings = _sums(learnt), _sums(spelled)
    counts = np.stack([_whole(spellings.get(k), 1 << bits, _RANGE // 2, np.uint16) for k in _SPELLINGS])
    return Model(
        _whole(classes.get("class"), ORDERS * SLOTS, _RANGE // 2, np.uint16).reshape(ORDERS, SLOTS), Mixer(PLACES).merged(classes.get("class mixer", {}).get(0)), counts, Mixer(PLACES).merged(spellings.get("spelling mixer", {}).get(0)),
        bits, int(total), int(types), int(single),
    )


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, total_bits, bits_per_byte of every document."""
    spark, blocks = df.sparkSession, blocks_for(size_bytes(df, text_col), block_bytes)
    made = df.select(F.col(id_col).alias("doc_id"), _train_flag(id_col).alias("train"), text_bytes(text_col).alias("text"))
    numbered, learners = made.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")), max(12, -(-blocks // 3))  # each learner sends its tables
    blocked = numbered.repartition(blocks, "block")  # by hash, so that the grouping by block below needs no shuffle of its own
    learnt = materialize(numbered.repartitionById(learners, F.pmod("block", F.lit(learners))).sortWithinPartitions("block", "doc_id", F.xxhash64("text"), "text").mapInArrow(_learn, _LEARNT), "learnt")
    of_token = Window.partitionBy("token")
    told = learnt.where("token is not null").select("block", "token", F.sum("n").over(of_token).alias("c"), (F.col("block") == F.min("block").over(of_token)).alias("first"))
    told = materialize(told, "told")
    shared = spark.sparkContext.broadcast(fit(learnt, told))
    kind = df.schema[id_col].dataType.simpleString()

    def sum_up(docs: pa.Table, told: pa.Table) -> pa.Table:
        model: Model = shared.value
        counted: dict[bytes, int] = {}
        for part in told.to_batches(max_chunksize=10_000):
            counted.update(zip(part.column("token").to_pylist(), part.column("c").to_pylist()))
        del told
        order, texts = pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]).to_numpy(), docs.column("text")  # texts stay where they are
        train, sizes = docs.column("train").to_numpy().astype(np.int64)[order], pc.binary_length(texts).to_numpy()[order]
        n, seen, low, own = [], [], [], []
        waiting: list[list[bytes]] = []
        known: list[np.ndarray] = []

        def flush(to: int) -> None:
            own.extend(model.log_probabilities(waiting, known, train[to - len(waiting) : to]).tolist())
            waiting.clear()
            known.clear()

        size = 0
        for k, place in enumerate(order.tolist()):
            tokens = tokens_of(texts[place].as_py())
            c = np.fromiter(map(counted.__getitem__, tokens), np.int64, len(tokens))
            n.append(len(tokens))
            seen.append(int(np.count_nonzero(c)))
            low.append(float(np.log10((c + 1) / (model.total + model.types + 1)).sum()))
            waiting.append(tokens)
            known.append(c)
            size += len(tokens)
            if size > 30_000:  # texts that are mixed together, each for itself
                flush(k + 1)
                size = 0
        flush(len(n))
        cost = -np.array(own) / math.log(2)
        return pa.table({
            "doc_id": docs.column("doc_id").take(pa.array(order)), "held_out": pa.array(train == 0), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(seen, pa.int64()), "train_tokens": pa.array([model.total] * len(n), pa.int64()),
            "base_score": pa.array(low, pa.float64()), "score": pa.array(np.array(own) / math.log(10)), "total_bits": pa.array(cost), "bits_per_byte": pa.array(cost / np.maximum(sizes, 1)),
        })

    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, total_bits double, bits_per_byte double"
    return blocked.groupBy("block").cogroup(told.select("block", "token", "c").groupBy("block")).applyInArrow(sum_up, out)
