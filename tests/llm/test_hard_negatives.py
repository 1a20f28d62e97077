"""Hard negatives against brute force: ties, copies, nulls, odd components, unequal lengths, empty tables, clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragrid.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, n_pos=5, n_neg=3, scale=256, low=50, high=95):
    kept = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = max((len(v) for _, v, _ in kept), default=0)
    whole = [[int(np.floor(scale * float(np.float32(x)))) for x in v] + [0] * (size - len(v)) for _, v, _ in kept]
    out = []
    for a, (i, _, y) in enumerate(kept):
        if i % every:
            continue
        score = [sum(p * q for p, q in zip(whole[a], w)) for w in whole]
        order = sorted(range(len(kept)), key=lambda k: (-score[k], kept[k][0], k))
        for p in [k for k in order if k != a and kept[k][2] == y][:n_pos]:
            inside = [k for k in order if kept[k][2] != y and low * score[p] <= 100 * score[k] <= high * score[p]]
            out += [(i, kept[p][0], r + 1, kept[k][0], score[p], score[k]) for r, k in enumerate(inside[:n_neg])]
    return sorted(out)


def mined(spark, rows, every, schema=SCHEMA):
    found = hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def cloud(n, dims, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) + 1.5
    return [(k, [float(np.float32(x)) for x in centres[k % labels] * 0.7 + rng.normal(size=dims) * 0.6], int(rng.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("dims", [1, 3, 16])
def test_equals_brute_force(spark, dims):
    rows = cloud(150, dims, dims)
    assert mined(spark, rows, 10) == brute(rows, 10) != []


def test_ties_and_copies(spark):
    rows = [(k, [1.0, 2.0, 2.0], 0) for k in range(40)] + [(100 + k, [1.0, 1.5, 1.0], 1) for k in range(30)] + [(100, [1.0, 1.5, 1.0], 1)] * 4 + [(0, [1.0, 2.0, 2.0], 0)] * 3
    assert mined(spark, rows, 20) == brute(rows, 20) != []


def test_rows_that_take_no_part_and_unequal_lengths(spark):
    rows = cloud(60, 4, 9) + [(None, [1.0] * 4, 1), (200, None, 1), (205, [1.0, None, 0.0, 0.0], 1), (210, [float("nan"), 0.0, 0.0, 0.0], 1), (215, [float("inf"), 0.0, 0.0, 0.0], 1), (220, [1.0] * 4, None), (225, [], 1), (230, [2.0, 1.0], 2), (235, [-0.001] * 4, 2)]
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_small_groups_change_nothing(spark, monkeypatch):
    rows = cloud(120, 5, 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    monkeypatch.setattr(hard_negatives, "PAIRS", 4)
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 7)
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_empty_clashing_and_too_large(spark):
    assert mined(spark, [], 5) == []
    rows = cloud(50, 3, 5)
    wide = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], SCHEMA + ", uid int, score int, `group` double")
    assert sorted(map(tuple, hard_negatives.mine(wide, F.col("id") % 10 == 0).collect())) == brute(rows, 10)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 2)], 1)


def test_bounds_prune_and_keep_what_counts():
    rng = np.random.default_rng(1)
    v = rng.integers(-200, 200, size=(400, 24))
    v[:, :4] *= 20
    q = np.linalg.eigh((v.T @ v).astype(float))[1][:, ::-1]
    cuts = hard_negatives.cuts_of(24)
    x = hard_negatives.Turned(v, q, cuts)
    a = x.take(np.arange(10))
    (i, j), = hard_negatives.survivors(a, x, np.ones((10, 400), bool), np.full((10, 1), -np.inf), np.full((10, 1), np.inf), 5, cuts)
    exact = v[:10] @ v.T
    for k in range(10):
        assert set(np.argsort(-exact[k], kind="stable")[:5]) <= set(j[i == k])
    assert len(i) < 0.05 * 4000
