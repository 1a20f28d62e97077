"""The quality classifier: its sums against brute force, equal scores for any layout, held-out accuracy, and the odd cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paragrid.llm import quality_classifier as qc

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"
TEXTS = [None, "", "  \n", "Ab1 ä-b", "x", "x x x", "ab,, cd\tef", "e", "f g! " * 40, "\x0b\x0c.", "日本 語"]


def token_texts(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0D]+", text or "")


def slot(token):
    data = np.frombuffer(token.encode(), np.uint8)
    return int(qc.tokens(data, np.array([0, len(data)]))[0][0])


def column(texts):
    return pa.array([(t or "").encode() for t in texts], pa.binary())


def test_tokens_are_runs_of_a_kind():
    for t in TEXTS:
        data = np.frombuffer((t or "").encode(), np.uint8)
        assert [int(x) for x in qc.tokens(data, np.array([0, len(data)]))[0]] == [slot(w) for w in token_texts(t)]
    assert len({slot(w) for w in map(str, range(2000))}) > 1850


def test_context_sums_equal_brute_force(spark):
    index, want, count = qc.index_vectors().astype(int), defaultdict(lambda: np.zeros(qc.DIMS, int)), defaultdict(int)
    assert (np.abs(index[:-1]).sum(1) == qc.NONZERO).all() and not index[-1].any()
    for t in TEXTS:
        seq = [slot(w) for w in token_texts(t)]
        for k, s in enumerate(seq):
            count[s] += 1
            for j in (k - 2, k - 1, k + 1, k + 2):
                if 0 <= j < len(seq):
                    want[s] = want[s] + index[seq[j]]
    total, counted = qc.word_vectors(spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3))
    assert {int(k): int(counted[k]) for k in np.flatnonzero(counted)} == dict(count)
    assert all((total[s] == want[s]).all() for s in count)


def test_pools_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    unit, weight = rng.normal(size=(1 << qc.SLOT_BITS, 4)).astype(np.float32), rng.random(1 << qc.SLOT_BITS)
    monkeypatch.setattr(qc, "STRETCH", 20)
    made = qc.pools(column(TEXTS), unit, weight)
    for t, row in zip(TEXTS, made):
        seq = [slot(w) for w in token_texts(t)]
        u, w = unit[seq].astype(float).reshape(-1, 4), weight[seq]
        want = [u.mean(0), (u * w[:, None]).sum(0) / w.sum()] if seq else [np.zeros(4)] * 2
        want += [(u[lag:] * u[:-lag]).sum(0) / max(1, len(seq) - lag) for lag in qc.LAGS]
        assert np.allclose(np.concatenate(want), row, atol=1e-5)


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    good = lambda: " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(5, 60)))
    bad = lambda: " ".join(r.choice(words) + r.choice(["$$$", "###", "%%%"]) for _ in range(r.randint(5, 60)))
    same = lambda: " ".join(w for w in r.choices(words, k=8) for _ in range(r.randint(3, 8)))
    kinds = [r.random() < 0.75 for _ in range(n)]
    return [(k, good() if g else r.choice([bad, same])()) for k, g in enumerate(kinds)], [(k, int(g)) for k, g in enumerate(kinds)]


@pytest.fixture(scope="module")
def made(spark):
    docs, labels = corpus(900, 4)
    return docs, labels, scored(spark, docs, [x for x in labels if x[0] % 3], parts=1)


def scored(spark, docs, labels, parts):
    found = qc.score(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(labels, LABELS).repartition(parts))
    assert found.columns == ["doc_id", "score"]
    return sorted(((r.doc_id, r.score) for r in found.collect()), key=repr)


def test_held_out_accuracy_and_calibration(made):
    _, labels, found = made
    truth, score = dict(labels), dict(found)
    held = [k for k in truth if k % 3 == 0]
    assert np.mean([(score[k] >= 0.5) == truth[k] for k in held]) > 0.95
    assert abs(np.mean([score[k] for k in held]) - np.mean([truth[k] for k in held])) < 0.05


def test_scores_do_not_depend_on_the_layout(spark, made):
    docs, labels, found = made
    shuffled = random.Random(1).sample(docs, len(docs))
    assert scored(spark, shuffled, [x for x in labels if x[0] % 3], parts=5) == found


def test_labels_that_may_not_teach_change_nothing(spark, made):
    docs, labels, found = made
    flipped = [(k, y if k % 3 else 1 - y) for k, y in labels]
    again = qc.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(flipped, LABELS), may_learn=F.col("doc_id") % 3 != 0)
    assert sorted(((r.doc_id, r.score) for r in again.collect()), key=repr) == found


def test_odd_rows_and_no_labels(spark):
    docs = [(None, "a b"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "wort " * 200_000)]
    found = scored(spark, docs, [(3, None), (None, 1)], parts=2)
    assert len(found) == 6 and {s for _, s in found} == {0.5}
    assert {s for _, s in scored(spark, docs, [(3, 1), (4, 1)], parts=2)} == {4 / 5}  # three labelled rows, all good
    assert scored(spark, [], [], parts=1) == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5, "x"), (2, "c ##", 0.1, "y")], DOCS + ", score double, slot string")
    labels = spark.createDataFrame([(1, 1, "t"), (2, 0, "u")], LABELS + ", text string")
    assert qc.score(docs, labels).columns == ["doc_id", "score"]
