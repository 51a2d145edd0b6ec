"""Whitening against a full decomposition on one machine."""

from __future__ import annotations

import math

import numpy as np

from quarryline.llm import whitening

COLUMNS = "vec_id long, embedding array<float>, label int"


def plain(rows: list[tuple]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The remaining rows as (id, x), the fit list, and the covariance's eigenvalues and eigenvectors, falling."""
    kept = []
    for i, v, *_ in rows:
        v = None if v is None else [None if c is None else float(np.float32(c)) for c in v]
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, tuple(math.floor(64 * c) + 1_000_000 for c in v)))
    fit = np.array(sorted({x for _, x in kept}), np.int64)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, w = np.linalg.eigh(c.T @ c / n)
    return kept, fit, e[::-1], w[:, ::-1]


def checked(spark, rows: list[tuple], count: int = 16, tolerance: float = 1e-9) -> None:
    kept, fit, e, w = plain(rows)
    n, s, d = len(fit), fit.sum(0), fit.shape[1]
    k = min(count, d)
    got: dict = {}
    for r in whitening.whiten(spark.createDataFrame(rows, COLUMNS).repartition(3), count=count).collect():
        got.setdefault(r.vec_id, []).append(r)
    assert {i: len(v) for i, v in got.items()} == {i: k * sum(1 for j, _ in kept if j == i) for i, _ in kept}
    sign: dict = {}
    for i, x in kept:
        c = (n * np.array(x) - s) / n
        for r in got[i]:
            p = r.component - 1
            assert r.n == n and r.deviation == sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True))
            assert abs(r.explained - e[p] / e.sum()) <= 1e-9 * (e[p] / e.sum())
            assert r.identity_error <= 1e-9
            want = float(c @ w[:, p]) / math.sqrt(e[p])
            if abs(want) > 1e-3:
                sign.setdefault(p, np.sign(r.whitened / want))
            assert abs(r.whitened - sign.get(p, 1.0) * want) < tolerance, (i, p)


def vectors(seed: int, n: int, d: int, fall: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)) * fall ** np.arange(d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return [(i, [float(np.float32(c)) for c in x], i % 3) for i, x in enumerate(v * 5)]


def test_flat_spectrum_is_expanded(spark):
    rows = vectors(1, 500, 40, 0.97)
    checked(spark, [*rows, (900, rows[3][1], 1), (901, rows[3][1], 1), (902, None, 1), (903, [None, *rows[0][1][1:]], 1), (904, [float("nan"), *rows[0][1][1:]], 1), (905, [float("-inf"), *rows[0][1][1:]], 0)])


def test_falling_spectrum_needs_few_passes(spark):
    rows = vectors(2, 400, 40, 0.25)
    checked(spark, [(i, [1000 * c for c in v], x) for i, v, x in rows], count=3, tolerance=1e-6)
    ready = whitening.prepared(spark.createDataFrame([(i, [1e6 * c for c in v], x) for i, v, x in rows], COLUMNS))
    fit = whitening.written(ready.select("x").distinct(), "test")
    x = np.array([r.x for r in fit.collect()])
    found = whitening.components(fit, whitening.Centre(len(x), [int(v) for v in x.sum(0)]), 3)
    assert not found["expanded"] and found["passes"] <= whitening.PASSES
    c = x - x.mean(0)
    e, w = np.linalg.eigh(c.T @ c / len(x))
    assert np.allclose(found["e"], e[::-1][:3], rtol=1e-10) and np.allclose(np.abs((found["w"] * w[:, ::-1][:, :3]).sum(0)), 1, atol=1e-10)


def test_few_dimensions_and_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "GATHER", 2)
    checked(spark, vectors(3, 200, 5, 0.9))


def test_odd(spark):
    frame = lambda rows: spark.createDataFrame(rows, COLUMNS)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None, 1), (2, [], 1), (3, [None], 1)])).count() == 0
    # one distinct vector: no variance
    same = whitening.whiten(frame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 2), (None, [1.0, 2.0], None)])).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.n == 1 and r.identity_error is None and r.explained is None for r in same)
    # other lengths go; fewer vectors than components
    two = whitening.whiten(frame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0], 1)])).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in two) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.identity_error < 1e-12 for r in two if r.component == 1)
    # exact beyond 64 bits, or null
    wide = whitening.whiten(spark.createDataFrame([(1, [0.0]), (2, [2.0**26]), (3, [2.0**46])], "vec_id long, embedding array<double>")).collect()
    s = [1_000_000, 2**32 + 1_000_000, 2**52 + 1_000_000]
    exact = [(3 * a - sum(s)) ** 2 for a in s]
    assert {r.vec_id: r.deviation for r in wide} == {i + 1: v if v < 2**63 else None for i, v in enumerate(exact)}
