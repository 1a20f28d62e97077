"""SimHash and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from paragrid.llm import simhash, suffix_dedup
from paragrid.llm.components import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


TEXTS = [None, "", "  \n", "One", "one TWO", "a b c", "A B C", "İstanbul ŞA é x", "x y z\x1cq w", "long " * 5000, "a b c d e f", "a b c d e g"]


def test_fingerprints_and_components(spark):
    r = random.Random(5)
    words = ["w%d" % k for k in range(40)]
    texts = TEXTS + [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) for _ in range(200)]
    for _ in range(80):  # copies with a word changed
        w = (r.choice(texts) or "").split() or ["x"]
        w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    assert all(x["fingerprint"] == f"{fps[x['doc_id']]:016x}" and x["component_id"] == want[x["doc_id"]] for x in got)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("centers, around", [(40, 5), (3, 150)])
def test_links_connect_all_near_fingerprints(spark, centers, around):
    """Planted fingerprints around a few centres, in small buckets and in full ones: components equal those of all pairs."""
    r = random.Random(centers)
    fps = {}
    for _ in range(centers):
        center = r.getrandbits(64)
        for _ in range(around):
            fps[len(fps)] = center ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 3))})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    told = spark.createDataFrame([(i, signed(x)) for i, x in fps.items()], "doc_id long, fp long")
    got = told.join(simhash.components(told), "fp").collect()
    want = brute_components(fps)
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_chains_prune_and_lose_no_pair(spark):
    """What the chains leave: exactly the fingerprints with a chain that meets another's, all near ones among them."""
    r = random.Random(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = [r.getrandbits(64) for _ in range(300)]
    for x in fps[:60]:
        fps.append(x ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 6))))
    fps = sorted(set(fps))
    masks = simhash._masks()

    def meets(a, b):
        x = a ^ b
        return any(not x & (masks[i] | masks[(i + 1) % 5]) and (x & masks[(i + 2) % 5]).bit_count() <= 1 for i in range(5))

    want = {a for a in fps if any(a != b and meets(a, b) for b in fps)}
    near = {a for a in fps if any(a != b and (a ^ b).bit_count() <= 2 for b in fps)}
    got = {x["fp"] & (1 << 64) - 1 for x in simhash._meeting(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert got == want and near <= got and len(near) < len(got) < len(fps)


def test_components_of_long_chains(spark):
    n = 60
    edges = [(k, k + 1) for k in range(0, n)] + [(100, 101), (5, 5)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_defined_cases(spark):
    rows = [(None, "same text here", "p", {"k": 1}), (7, "same text here", "q", None), (7, "same text here", "q", None), (None, "alone in the world", "r", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP string, extra map<string,int>")
    got = simhash.keep_one(df)
    assert got.columns == df.columns and sorted((x["doc_id"] or -1, x["text"]) for x in got.collect()) == [(-1, "alone in the world"), (7, "same text here")]
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def brute_removal(texts, width=200):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + width] for b in bodies for k in range(len(b) - width + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [200_000, 2])
def test_repeated_strings(spark, limit):
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice(["ka", "lo", "é", "tre", "su", "the"]) for _ in range(r.randint(1, 4))) for _ in range(n))
    passages = [text(90) for _ in range(4)]
    texts = [None, "", "a" * 199, "a" * 200, "b" * 450, "ab" * 180, "q" * 201]
    for _ in range(90):
        k, t = r.random(), text(r.randint(0, 140))
        if k < 0.35:
            t = t + r.choice(passages) + text(r.randint(0, 50))
        elif k < 0.5:
            t = r.choice(passages)[: r.randint(150, 300)] + t
        elif k < 0.6:
            t = r.choice(texts) or ""
        elif k < 0.7:
            b = r.choice(texts) or ""
            cut = r.randint(0, len(b))
            t = b[:cut] + "X" + b[cut:]
        texts.append(t)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(df, group_limit=limit).collect()}
    want = brute_removal(texts)
    assert len(got) == len(texts)
    assert [(got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) for k in range(len(texts))] == want
    assert all(hashlib.sha256(bytes(x["kept"])).hexdigest() == x["kept_sha256"] for x in got.values())


def test_repeats_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "z" * 100 + "y" * 150), (None, "z" * 100 + "y" * 150), (3, "short")], "doc_id long, text string")
    got = sorted((x["n_bytes"], x["n_removed"], x["n_spans"]) for x in suffix_dedup.remove_repeats(df).collect())
    assert got == [(5, 0, 0), (250, 250, 1), (250, 250, 1)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    """A text cut into overlapping pieces gives the segments of its windows once each."""
    import numpy as np

    body = bytes(random.Random(1).choices(b"abc ", k=5000))
    monkeypatch.setattr(suffix_dedup, "_LONG", 700)
    places = []
    for numbers, offsets, parts in suffix_dedup._pieces([b"short", body], 200):
        sizes = np.array([len(x) for x in parts])
        doc, p, more, _, _ = suffix_dedup.segments(np.frombuffer(b"".join(parts), np.uint8), sizes)
        for d, a, m in zip(doc, p, more):
            assert numbers[d] == 1
            places += range(offsets[d] + a, offsets[d] + a + m + 1)
    assert sorted(places) == list(range(5000 - 199))


def test_merge_of_front_coded_runs():
    r = random.Random(2)
    for _ in range(200):
        strings = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(40))
        runs = [[] for _ in range(r.randint(1, 9))]
        for s in strings:
            runs[r.randrange(len(runs))].append(s)
        merged = suffix_dedup.merge([(shared.tolist(), rests) for shared, rests in map(suffix_dedup.front_code, runs)])
        got = [runs[a][b] for a, b, _ in merged]
        assert got == strings
        assert [n for _, _, n in merged[1:]] == [suffix_dedup._shared(a, b, 0) for a, b in zip(got, got[1:])]


def test_unhashable_extra_columns(spark):
    df = spark.createDataFrame([(1, "x y z", {"a": 1})], "doc_id long, text string, m map<string,int>").withColumn("n", F.array(F.lit(1)))
    assert simhash.keep_one(df).count() == 1
