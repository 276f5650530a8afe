"""Solvers over many problems against the same problem alone."""

import numpy as np
import pytest

from spectralake.functions import batched, solver
from spectralake.operators import bands, pattern


def test_least_squares_as_alone():
    rng = np.random.default_rng(2)
    sizes, width = rng.integers(12, 40, 60), 40
    x = rng.uniform(-2, 2, (60, width))
    truth = np.column_stack([rng.uniform(0.5, 5, 60), rng.uniform(-1, 1, 60), rng.uniform(0.1, 1, 60)])
    y = solver.gaussian(x, truth[:, :1], truth[:, 1:2], truth[:, 2:]) + rng.normal(0, 0.05, x.shape)
    here = np.arange(width) < sizes[:, None]
    start, low, high = np.tile([1.0, 0.1, 0.5], (60, 1)), [0.0, -0.8, 0.2], [np.inf, 0.8, 0.9]
    p, sse, settled = batched.least_squares(lambda q, k: batched.gaussians(x[k], q[..., :1], q[..., 1:2], q[..., 2:]), y, here, start, low, high)
    for i in range(60):
        n = sizes[i]
        one = solver.bounded_least_squares(lambda q, t: solver.gaussian(t, q[..., :1], q[..., 1:2], q[..., 2:3]), start[i], low, high, x[i, :n], y[i, :n])
        assert p[i] == pytest.approx(one[0], abs=1e-5) and sse[i] == pytest.approx(one[1], rel=1e-5) and settled[i] == one[2]


def test_five_diagonals_and_baselines_as_alone():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 3, 4, 7, 50, 33])
    y = rng.normal(0, 1, (8, 50)) + 30 * np.exp(-((np.arange(50) - 20) / 3.0) ** 2)
    curve, settled = batched.smooth_below(y, sizes, 1e4, 1e-3, 6)
    for i, n in enumerate(sizes):
        one, done = solver.smooth_below(y[i, :n], 1e4, 1e-3, 6)
        assert np.allclose(curve[i, :n], one) and settled[i] == done
    main, near, far, right = rng.uniform(9, 10, (4, 12)), rng.normal(0, 1, (4, 12)), rng.normal(0, 1, (4, 12)), rng.normal(0, 1, (4, 12))
    far[:, -2:], near[:, -1:] = 0, 0
    for i, x in enumerate(batched.solve_five(main, near, far, right)):
        assert np.allclose(x, solver.solve_five(main[i], near[i, :-1], far[i, :-2], right[i]))
    base, settled = batched.polynomial_below(y, 6)
    for i in range(8):
        one, done = solver.polynomial_below(y[i], 6)
        assert np.allclose(base[i], one) and settled[i] == done


def test_chunks_hold_every_row_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(batched, "CHUNK", 20)
    sizes = [0, 3, 50, 1, 1, 7, 0, 6]
    lists = batched.Lists(pa.array([[{"v": float(i)}] * n for i, n in enumerate(sizes)], pa.list_(pa.struct([("v", pa.float64())]))).slice(1))
    chunks = [c.tolist() for c in lists.chunks()]
    assert sorted(sum(chunks, [])) == list(range(7)) and all(len(c) == 1 or max(sizes[1 + i] for i in c) * len(c) <= 20 for c in chunks)
    values, here = lists.padded("v", np.array([0, 3]))
    assert here.tolist() == [[True] * 3, [True, False, False]] and values[0].tolist() == [1.0] * 3 and values[1][0] == 4.0


def test_als_and_polynomial_on_odd_slices(spark):
    rows = [("gap", 1.0 + i, i, None if i == 2 else 5.0 + i, 1 <= i <= 3) for i in range(6)] + [("none", 1.0, 0, None, True), ("one", 1.0, 0, 4.0, True)]
    table = spark.createDataFrame([(1, 0, *r) for r in rows], "shot long, frame long, band string, wl double, seq long, y double, core boolean")
    got = {(r.band, r.seq): (r.y, r.baseline) for r in bands.subtract_als(table).collect()}
    assert set(got) == {("gap", 1), ("gap", 2), ("gap", 3), ("none", 0), ("one", 0)}
    level = solver.smooth_below([5.0, 6, 8, 9, 10], 1e7, 1e-5, 5)[0].mean()
    assert got["gap", 1] == pytest.approx((6 - level, level), abs=1e-6) and got["gap", 2][0] is None
    assert got["none", 0] == (None, None) and got["one", 0] == pytest.approx((0.0, 4.0))
    profiles = spark.createDataFrame([(1, 0, k, y, float(y * y + k)) for k, n in ((0, 30), (1, 20), (2, 30)) for y in range(n)][::-1],
                                     "shot long, frame long, x long, y long, amplified double")
    base = {(r.x, r.y): r.base for r in pattern.poly_baseline(profiles, 6).collect()}
    assert len(base) == 80 and all(abs(b - y * y - x) < 1e-6 for (x, y), b in base.items())
    assert pattern.poly_baseline(profiles.where("false")).collect() == [] and bands.subtract_als(table.where("false")).collect() == []
