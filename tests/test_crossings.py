"""Crossings of spectra, knot cells and profiles with lost rows, against plain code."""

import numpy as np
import pytest

from spectralake.operators import absolute, pattern, wavelength


def plain_crossings(a, b):
    """Sorted (wl, level) where two polylines of (wl, value) meet."""
    (ax, ay), (bx, by) = (np.array(sorted(c)).T for c in (a, b))
    grid = np.unique(np.concatenate([ax, bx]))
    grid = grid[(grid >= max(ax[0], bx[0])) & (grid <= min(ax[-1], bx[-1]))]
    v, w = np.interp(grid, ax, ay), np.interp(grid, bx, by)
    d = v - w
    out = [(g, h) for g, h, z in zip(grid, v, d) if z == 0]
    for i in range(len(grid) - 1):
        if d[i] * d[i + 1] < 0:
            t = d[i] / (d[i] - d[i + 1])
            out.append((grid[i] + t * (grid[i + 1] - grid[i]), v[i] + t * (v[i + 1] - v[i])))
    return sorted(out)


def test_every_crossing(spark):
    rng = np.random.default_rng(8)
    curves = {}
    for cal in range(3):
        for o in (0, 1, 4):
            n = 25 if cal < 2 else 3
            wl = 700 - 6.0 * o - np.sort(rng.uniform(0, 40, n)) if cal < 2 else 700 - 10.0 * o - np.arange(n)
            curves[cal, o] = [(float(w), float(v)) for w, v in zip(wl, rng.integers(0, 9, n))]
    rows = [(c, o, i, w, s) for (c, o), points in curves.items() for i, (w, s) in enumerate(points)]
    table = spark.createDataFrame(rows, "cal_id long, ord long, x long, wl double, s double")
    got = {}
    for r in wavelength.all_crossings(table, table.withColumnRenamed("s", "counts")).collect():
        got.setdefault((r.cal_id, r.ord, r.next_ord), []).append((r.wl, r.level))
    want = {(c, a, b): plain_crossings(curves[c, a], curves[c, b]) for c in range(3) for a, b in ((0, 1), (1, 4))}
    assert set(got) == {k for k, v in want.items() if v} and len(got) >= 4
    for key, places in got.items():
        assert np.allclose(sorted(places), want[key])


def test_touching_points_count_once(spark):
    rows = [(1, 0, 0, 1.0, 0.0), (1, 0, 1, 2.0, 1.0), (1, 0, 2, 3.0, 0.0), (1, 1, 0, 1.0, 2.0), (1, 1, 1, 2.0, 1.0), (1, 1, 2, 3.0, 2.0)]
    table = spark.createDataFrame(rows, "cal_id long, ord long, x long, wl double, s double")
    got = wavelength.all_crossings(table, table.withColumnRenamed("s", "counts")).collect()
    assert [(r.wl, r.level) for r in got] == [(2.0, 1.0)]
    assert wavelength.all_crossings(table.where("ord = 0"), table.withColumnRenamed("s", "counts")).collect() == []


@pytest.mark.parametrize("cell", [0.3, 8.0, 5000.0])
def test_irradiance_does_not_depend_on_the_cell(spark, monkeypatch, cell):
    monkeypatch.setattr(absolute, "CELL_NM", cell)
    um, mw = [0.4, 0.4005, 0.42, 0.5], [1.0, 2.0, 5.0, 3.0]
    knots = spark.createDataFrame([(1, u, m) for u, m in zip(um, mw)], "cal_id long, um double, mw double")
    wl = [399.9, 400.0, 400.2, 400.5, 408.0, 420.0, 459.9, 500.0, 500.1]
    points = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate([*wl, None])] + [(2, 0, 0, 410.0)], "cal_id long, ord long, x long, wl double")
    got = {(r.cal_id, r.x): r.irradiance for r in absolute.irradiance_linear(points, knots).collect()}
    assert len(got) == len(wl) + 2
    for i, w in enumerate(wl):
        assert got[1, i] == (None if not 400 <= w <= 500 else pytest.approx(float(np.interp(w, np.array(um) * 1000, mw))))
    assert got[1, len(wl)] is None and got[2, 0] is None


def test_profile_keeps_the_place_of_lost_rows(spark):
    rows = [(1, 0, 5, y, y * y) for y in range(40) if y != 11]
    profiles = spark.createDataFrame(rows, "shot long, frame long, x long, y int, counts long")
    spacing = spark.createDataFrame([(1, 0, 5, 0, 20, 10.0)], "shot long, frame long, x long, ord long, y long, smooth_spacing double")
    got = {r.dy: r.z for r in pattern.order_profile(profiles, spacing, 40, margin=5).collect()}
    assert set(got) == set(range(-10, 10)) and got[-9] is None
    assert got[5] == pytest.approx((25 * 25 - 100) / (29 * 29 - 100))
