"""Operator 11 against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _brute(rows, anchors):
    sound = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        sound[i] = label, np.array([math.floor(256 * x) for x in v], np.int64)
    out = []
    for a in anchors:
        if a not in sound:
            continue
        label, q = sound[a]
        scored = sorted((-int(v @ q), i, y == label) for i, (y, v) in sound.items() if i != a)
        for p_less, p, _ in [s for s in scored if s[2]][:5]:
            fit = [(n, i) for n, i, same in scored if not same and -50 * p_less <= -100 * n <= -95 * p_less][:3]
            out += [(a, p, k + 1, i, -p_less, -n) for k, (n, i) in enumerate(fit)]
    return Counter(out)


def _found(spark, rows, anchors, types=ROWS):
    df = spark.createDataFrame(rows, types)
    for name in ("point", "score", "ids", "row", "steps"):
        df = df.withColumn(name, F.lit("clash"))
    asked = spark.createDataFrame([(a,) for a in anchors], "vec_id long")
    return Counter(tuple(r[c] for c in OUT) for r in negatives.hard_negatives(df, asked).collect())


def _clustered(n=300, dims=20, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.6, 3.0], (n, 1))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[40:140] = v[7]  # a third are copies, in several labels
    v[200:230] = np.round(v[200:230])  # ties
    return [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, and thresholds that have to be lowered
        for name, value in (("BLOCK", 7), ("STRIPE", 20), ("SAMPLE", 64)):
            monkeypatch.setattr(negatives, name, value)
    rows = _clustered()
    anchors = [*range(0, 300, 10), 41, 77]
    assert _found(spark, rows, anchors) == _brute(rows, anchors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [0.7, 0.0], 2), (4, [0.7, 0.0], 2), (5, [0.6, 0.3], 3), (6, [0.5, 0.0], 2),
        (7, None, 1), (8, [nan, 1.0], 1), (9, [1.0, None], 1), (10, [inf, 0.0], 2), (11, [0.8, 0.0], None), (None, [1.0, 0.0], 2), (12, [0.0, 0.0], 1),
        (13, [-1.0, 0.0], 1), (14, [], 1), (15, [1.0], 1), (16, [0.0, 0.0], 9),
    ]
    anchors = [0, 1, 2, 7, 12, 13, 16, 99, 0]
    two = [r for r in rows if r[1] is None or len(r[1]) != 1]
    assert _found(spark, rows, anchors) == _brute(two, sorted(set(anchors)))
    assert _found(spark, [*rows, rows[0], rows[3]], anchors) == _brute(two, sorted(set(anchors)))  # repeated rows count once
    assert not _found(spark, rows, [7])
    empty = spark.createDataFrame([], ROWS)
    assert negatives.hard_negatives(empty, empty).count() == 0
    with pytest.raises(ValueError, match="too large"):
        _found(spark, [(0, [1e30, 1.0], 1)], [0])


def test_large_components_stay_exact(spark):
    rows = [(i, [float((i * 37) % 11 + 1e5), float(i)], i % 2) for i in range(30)]
    assert _found(spark, rows, range(0, 30, 5)) == _brute(rows, range(0, 30, 5))


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 40), st.integers(1, 70), st.sampled_from([np.float64, np.int64]))
def test_join_is_exact(seed, m, n, d, kind):
    rng = np.random.default_rng(seed)
    q, x = (np.floor(rng.normal(size=(k, d)) * rng.choice([1, 100], (k, 1))).astype(kind) for k in (m, n))
    scores = q @ x.T
    t = np.quantile(scores, rng.uniform(0, 1, m), axis=None).astype(np.float64)
    a, r, s = negatives.reached(q, negatives._norms(q), t, x)
    want = np.nonzero(scores >= t[:, None])
    assert sorted(zip(a.tolist(), r.tolist(), s.tolist(), strict=True)) == sorted(zip(*(w.tolist() for w in want), scores[want].astype(int).tolist(), strict=True))


def test_index_leaves_dimensions_out():
    """Rows that no ask can reach are never touched, and pairs far below the threshold are dropped after one block."""
    rng = np.random.default_rng(1)
    q = rng.normal(size=(4, 64)) * 100
    near, far = q + rng.normal(size=q.shape), rng.normal(size=(500, 64)) * 10
    x = np.floor(np.vstack([near, far]))
    q = np.floor(q)
    covered = negatives._norms(x) * negatives._norms(q).max(0) < 0.8 * (q * q).sum(1).min()
    assert covered[4:].all() and not covered[:4, -1].any() and covered[:4, :20].all()
    a, r, _ = negatives.reached(q, negatives._norms(q), 0.8 * (q * q).sum(1), x)
    assert sorted(zip(a.tolist(), r.tolist(), strict=True)) == [(i, i) for i in range(4)]
