"""Whitening and hard negatives beside brute force in plain numpy and Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hardneg, whitening

VEC = "vec_id bigint, embedding array<float>, label int, x int, rid int, white int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1) for r in rows], VEC)


def vectors(n, size, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, size)) * spread + rng.standard_normal(size)).astype(np.float32)


@pytest.mark.parametrize("reach", [1, 12, 40])
def test_weighted_popcounts_are_the_cross_products(reach):
    rng = np.random.default_rng(reach)
    x = rng.integers(0, 1 << reach, (131, 5), dtype=np.uint64)
    x[:, 2] = 0
    bits = np.array([int(c).bit_length() for c in x.max(axis=0)])
    got = whitening.cross_products(x, bits)
    exact = x.astype(object).T @ x.astype(object)
    assert [[int(got[i, j]) for j in range(i, 5)] for i in range(5)] == [
        [int(exact[i, j]) for j in range(i, 5)] for i in range(5)
    ]


def test_whitening_equals_numpy(spark):
    v = vectors(700, 12, 1)
    rows = [(n, x.tolist(), 0) for n, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 11, 1), (1002, [math.nan] * 12, 1), (1003, [math.inf] * 12, 1)]
    got = whitening.whiten(frame(spark, rows).repartition(5)).collect()
    x = np.floor(1024.0 * v.astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    expected = centred @ basis / np.sqrt(values)
    assert len(got) == 700 * 8 and {r.n for r in got} == {700}
    table = np.zeros((700, 8))
    for r in got:
        table[r.vec_id, r.component - 1] = r.whitened
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert r.deviation == exact
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
    sign = np.sign((table * expected).sum(axis=0))
    assert np.allclose(table * sign, expected, atol=1e-7)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_edge_cases(spark):
    assert whitening.whiten(frame(spark, [(1, None, 0), (2, [], 0)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25], 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [
        (1, 1, 0, None, None),
        (2, 1, 0, None, None),
    ]
    # Repeated rows count, a null id stays, a constant dimension has no variance, sizes are apart.
    rows = [(1, [0.5, 0.1], None), (1, [0.5, 0.1], None), (None, [0.75, 0.1], 3), (4, [1.0, 0.0, 0.0], 3)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 3 * 2 + 3
    assert sorted({(r.vec_id, r.n) for r in got}, key=str) == [(1, 3), (4, 1), (None, 3)]
    first = [r.whitened for r in got if r.component == 1 and r.vec_id != 4]
    assert np.allclose(np.abs(first), [0.5**0.5, 0.5**0.5, 2**0.5]) and sum(first) == pytest.approx(0)
    assert {r.whitened for r in got if r.component == 2} == {None}
    # Values far apart need wide planes and sums beyond 64 bits.
    wide = whitening.whiten(frame(spark, [(n, [float(n) * 1e13, 1.0], 0) for n in range(5)])).collect()
    x = [int(np.float32(n * 1e13)) * 1024 for n in range(5)]
    exact = [(5 * a - sum(x)) ** 2 for a in x]
    assert {(r.vec_id, r.deviation) for r in wide} == {(n, d if d < 1 << 63 else None) for n, d in enumerate(exact)}
    assert np.allclose(sorted(r.whitened for r in wide if r.component == 1), (np.arange(5) - 2) / 2**0.5, atol=1e-5)


def mined(rows):
    """All pairs, in plain Python."""
    good = [
        (i, label, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v, label in rows
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for n, (anchor, label, q) in enumerate(good):
        if anchor is None or anchor % 50:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, p, strict=True)), math.inf if i is None else i, m, i, other == label)
            for m, (i, other, p) in enumerate(good)
            if m != n and len(p) == len(q)
        ]
        scored.sort(key=lambda s: s[:3])
        for positive in [s for s in scored if s[4]][:5]:
            p = -positive[0]
            fit = [s for s in scored if not s[4] and 50 * p <= -100 * s[0] <= 95 * p]
            out += [(anchor, positive[3], k, s[3], p, -s[0]) for k, s in enumerate(fit[:3], 1)]
    return sorted(out, key=str)


def run(frame):
    return sorted(map(tuple, hardneg.mine(frame, F.col("vec_id") % 50 == 0).collect()), key=str)


@pytest.mark.parametrize("blocks", [(4096, 512), (37, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hardneg, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", blocks[1])
    monkeypatch.setattr(hardneg, "FIRST_DEPTH", 2)
    v = vectors(400, 6, 3, spread=0.8)
    # Few distinct values, so that scores tie often; a hot label; signs of both kinds.
    v[:200] = np.round(v[:200] * 2) / 2
    labels = np.random.default_rng(4).choice(5, 400, p=[0.6, 0.1, 0.1, 0.1, 0.1])
    rows = [(n, x.tolist(), int(k)) for n, (x, k) in enumerate(zip(v, labels, strict=True))]
    rows += [(450, [0.0] * 6, 0), (500, None, 1), (550, [1.0] * 6, None), (600, [math.nan] * 6, 2)]
    rows += [(None, [0.5] * 6, 1), (650, [0.5, None, 1.0, 1.0, 1.0, 1.0], 1), (700, [0.5] * 3, 1), (701, [0.25] * 3, 2)]
    got = run(frame(spark, rows))
    assert got == mined(rows) and len(got) > 60


def test_hard_negatives_of_nothing_and_of_repeated_rows(spark):
    assert run(frame(spark, [(1, [1.0], 0)]).limit(0)) == []
    assert run(frame(spark, [(50, [1.0], 0)])) == []
    rows = [(50, [1.0, 1.0], 0)] * 2 + [(3, [0.5, 0.5], 1)] * 2
    # Each of the two anchors has the other as its positive, and both copies as negatives.
    assert run(frame(spark, rows)) == sorted([(50, 50, k, 3, 131072, 65536) for k in (1, 2)] * 2, key=str)
