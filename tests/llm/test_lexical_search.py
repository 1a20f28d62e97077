"""Ranked search against brute force: ties, copies, nulls, empty and long texts, repeated items, small shards and blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from paragrid.llm import lexical_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    with_terms = [d for d in counted if d[2]]
    n_all, length, df = len(with_terms), sum(d[2] for d in with_terms), Counter(t for d in with_terms for t in d[1])
    out = []
    for item, text in items:
        scored = []
        for i, tf, n in with_terms:
            m = 100 - 25 + (25 * n * n_all) // length
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            scored.append((-s, i is None, i or 0, i, s))
        best = sorted(x[:3] + (x[3] is None, x[4]) for x in scored if x[4] > 0)[:k]
        out += [(item, r + 1, None if x[1] else x[2], x[4]) for r, x in enumerate(best)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, k=20):
    found = lexical_search.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def texts(n, seed, words=60, most=40):
    r = random.Random(seed)
    return [" ".join(r.choice(["w", "W", "é", "ñ1"]) + str(int(r.expovariate(0.15)) % words) + r.choice(["", ",", "-x", "_", " z"]) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_equals_brute_force(spark):
    docs, items = list(enumerate(texts(120, 1))), list(enumerate(texts(12, 2)))
    assert ranked(spark, docs, items, 5) == brute(docs, items, 5) != []


def test_ties_choose_the_smallest_ids(spark):
    docs = [(i, "same words here") for i in random.Random(3).sample(range(1000), 80)] + [(2000 + i, "other words") for i in range(40)] + [(None, "same words here"), (5000, "none of them")]
    items = [(1, "same here"), (1, "words words"), (2, "same here"), (None, "other")]
    assert ranked(spark, docs, items) == brute(docs, items) != []


def test_small_shards_and_blocks_change_nothing(spark, monkeypatch):
    docs, items = list(enumerate(texts(90, 5))), list(enumerate(texts(9, 6)))
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 7)
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 900)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", 300)
    assert ranked(spark, docs, items, 4) == brute(docs, items, 4) != []


def test_null_empty_and_long_texts(spark):
    docs = [(1, None), (2, ""), (3, "--- ,,"), (4, "wort " * 60_000 + "selten"), (5, "Wort"), (5, "Wort"), (6, "x" * 200_000)]
    items = [(1, "wort selten"), (2, None), (3, ""), (4, "unknown"), (5, "x" * 200_000)]
    assert ranked(spark, docs, items) == brute(docs, items) != []


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_empty_tables(spark, docs, items):
    assert ranked(spark, docs, items) == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "q"), (2, "b c", 2, "r")], DOCS + ", score int, query string")
    items = spark.createDataFrame([(7, "b c", 3, 4)], ITEMS + ", rank int, doc_id int")
    assert sorted(map(tuple, lexical_search.rank(docs, items).collect()), key=repr) == brute([(1, "a b"), (2, "b c")], [(7, "b c")])


def test_one_index_serves_many_searches(spark):
    docs = spark.createDataFrame(list(enumerate(texts(50, 8))), DOCS)
    n_docs, n_terms = lexical_search.totals(docs)
    index = lexical_search.build_index(docs, n_docs, n_terms)
    for seed in (9, 10):
        items = list(enumerate(texts(4, seed)))
        found = lexical_search.search(index, spark.createDataFrame(items, ITEMS), n_docs, 3)
        assert sorted(map(tuple, found.collect()), key=repr) == brute(list(enumerate(texts(50, 8))), items, 3)
