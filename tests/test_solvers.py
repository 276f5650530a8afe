"""Numerics against numpy and planted truth."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectralake.functions import polyfit, solver
from spectralake.operators import absolute, bands, pattern, wavelength


def test_polynomial_fit_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        for px in rng.uniform(0, 2560, 3 + 3 * g):
            rows.append((g, float(px), float(800 - 3.0 * g - 0.008 * px - 3e-7 * px * px + rng.normal(0, 1e-3))))
    df = spark.createDataFrame(rows, "g long, x double, y double")
    fits = polyfit.fit_polynomial(df, ["g"], "x", "y", origin=1280)
    got = fits.withColumn("x", F.explode(F.array(*[F.lit(float(v)) for v in (0, 640, 2559)]))).select(
        "g", "x", polyfit.evaluate(F.col("x"), origin=1280).alias("y")).toPandas()
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    for r in got.itertuples():
        p = pdf[pdf.g == r.g]
        assert abs(np.polyval(np.polyfit(p.x - 1280, p.y, 2), r.x - 1280) - r.y) < 1e-9


def test_fit_degrees_and_degenerate_groups(spark):
    df = spark.createDataFrame(
        [(0, 1.0, 3.0), (1, 1.0, 3.0), (1, 2.0, 5.0), (2, 4.0, 1.0), (2, 4.0, 1.0), (2, 5.0, 2.0), (3, None, 1.0),
         (3, 1.0, 1.0), (3, 2.0, 4.0), (3, 3.0, 9.0)], "g long, x double, y double")
    got = {r.g: r for r in polyfit.fit_polynomial(df, ["g"], "x", "y").collect()}
    assert got[0].degree == 1 and got[0].c1 is None
    assert got[1].degree == 1 and got[1].c2 == 0 and got[1].c1 == pytest.approx(2000)
    assert got[2].degree == 2 and got[2].c2 is None
    assert got[3].n == 3 and got[3].c2 == pytest.approx(1e6)


def test_cubic_spline_is_exact_on_cubics_and_refuses_outside(spark):
    cubic = lambda t: 1 + 2 * t - 3 * t**2 + 0.5 * t**3
    um = np.array([0.3, 0.35, 0.42, 0.5, 0.62, 0.8, 1.0])
    knots = spark.createDataFrame([(7, float(u), float(cubic(u))) for u in um], "cal_id long, um double, mw double")
    wl = [300.0, 333.3, 420.0, 555.5, 999.9, 1000.0]
    points = spark.createDataFrame([(7, 0, i, w) for i, w in enumerate(wl)], "cal_id long, ord long, x long, wl double")
    got = absolute.irradiance_cubic(points, knots).orderBy("x").toPandas()
    assert np.allclose(got.irradiance, [cubic(w / 1000) for w in wl], atol=1e-9)
    far = spark.createDataFrame([(7, 0, 0, 299.0)], points.schema)
    assert absolute.irradiance_cubic(far, knots).first().irradiance is None
    with pytest.raises(Exception, match="outside the lamp"):
        absolute.irradiance_linear(far, knots, strict=True).collect()


def test_baseline_lies_under_the_peaks():
    x = np.linspace(0, 1, 120)
    y = 2 + 3 * x + 50 * np.exp(-((x - 0.5) / 0.03) ** 2)
    curve, _ = solver.smooth_below(y, 1e7, 1e-5, 5)
    assert np.abs(curve - (2 + 3 * x)).max() < 0.05
    base, settled = solver.polynomial_below(np.r_[y], 6)
    assert settled
    assert base[60] < 15 and abs(base[5] - y[5]) < 3


def planted(spark, truth, n=41):
    rows = []
    for band, (wl0, lines, centre, sigma, delta) in truth.items():
        for i, wl in enumerate(np.linspace(wl0 - 0.5, wl0 + 0.9, n)):
            y = sum(solver.gaussian(wl, delta * r, centre + o, sigma) for o, r in lines)
            rows.append((1, 2, band, float(wl), i, float(y)))
    return spark.createDataFrame(rows, "shot long, frame long, band string, wl double, seq long, y double")


TRUTH = {"a": (500.0, [(0.0, 1.0)], 500.013, 0.031, 2.0),
         "b": (600.0, [(0.0, 1.0), (0.25, 0.5), (0.4, 2.0)], 599.98, 0.05, 0.7)}


def planted_ratios(spark):
    return spark.createDataFrame(
        [(b, i, wl0, float(o), float(r)) for b, (wl0, lines, *_) in TRUTH.items() for i, (o, r) in enumerate(lines)],
        "band string, line long, wl0 double, offset double, ratio double")


def test_band_fit_recovers_planted_lines(spark):
    slices, ratios = planted(spark, TRUTH), planted_ratios(spark)
    fits = bands.fit_bands(slices, ratios).toPandas().set_index("band")
    grid = bands.fit_bands_grid(slices, ratios).toPandas().set_index("band")
    for band, (_, lines, centre, sigma, delta) in TRUTH.items():
        assert fits.loc[band, ["centre", "sigma", "delta"]].astype(float).tolist() == pytest.approx(
            [centre, sigma, delta], rel=1e-5)
        assert grid.loc[band, "centre"] == pytest.approx(centre, abs=2e-3)
        assert grid.loc[band, "sigma"] == pytest.approx(sigma, abs=1e-3)
    samples = bands.fit_samples(bands.fit_bands(slices, ratios), ratios, slices)
    area = bands.integrate_fit(samples).toPandas().set_index("band").intensity
    whole = bands.integrate(slices).toPandas().set_index("band").intensity
    for band, (_, lines, _, _, delta) in TRUTH.items():
        assert area[band] == pytest.approx(delta * sum(r for _, r in lines), rel=1e-3)
        assert area[band] == pytest.approx(whole[band], rel=1e-2)


def test_fit_keeps_width_and_amplitude_inside_bounds(spark):
    narrow = {"a": (500.0, [(0.0, 1.0)], 500.0, 0.004, 1.0)}
    got = bands.fit_bands(planted(spark, narrow), planted_ratios(spark)).first()
    assert got.sigma >= bands.SIGMA_RANGE[0] - 1e-12 and got.delta >= 0


def test_line_centre_fit_and_seed(spark):
    rows = []
    for at, centre in ((20, 20.37), (60, 58.9)):
        for x in range(at - 10, at + 10):
            rows.append((1, 0, at, x, float(solver.gaussian(float(x), 40.0, centre, 1.7))))
    windows = spark.createDataFrame(rows, "cal_id long, ord long, px0 long, x long, level double")
    fit = wavelength.fit_line_centers(windows).orderBy("px0").toPandas()
    assert fit.centre.tolist() == pytest.approx([20.37, 58.9], abs=1e-5)
    assert fit.sigma.tolist() == pytest.approx([1.7, 1.7], rel=1e-5)
    seed = wavelength.line_center_seed(windows).orderBy("px0").toPandas()
    assert seed.centre.tolist() == pytest.approx([20.37, 58.9], abs=1e-6)


def test_profile_fit_finds_the_shift(spark):
    x = np.arange(-40, 40)
    z = solver.gaussian(x, 30.0, 3.0, 11.0)
    rows = [(1, 0, 5, 2, int(a), float((b - z.min()) / (z.max() - z.min()))) for a, b in zip(x, z)]
    df = spark.createDataFrame(rows, "shot long, frame long, x long, ord long, dy long, z double")
    got = pattern.fit_profile(df).first()
    assert got.sse < 1e-2 and 10 <= got.sigma <= 15


def test_smoothing_matches_a_least_squares_filter(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(10, 3, 60)
    win, half = 21, 10
    want = np.array([y[max(0, i - half):i + half + 1].mean() for i in range(60)])
    for part, at in ((slice(0, win), range(half)), (slice(60 - win, 60), range(60 - half, 60))):
        line = np.polyfit(np.arange(60)[part], y[part], 1)
        for i in at:
            want[i] = np.polyval(line, i)
    df = spark.createDataFrame([(1, 0, 7, i, float(v)) for i, v in enumerate(y)],
                               "shot long, frame long, x long, y long, counts double")
    got = pattern.smooth_profile(df, win).orderBy("y").toPandas().smooth
    assert np.allclose(got, want)


def test_order_spacing_matches_numpy(spark):
    y = np.array([3, 11, 20, 28, 39, 51, 60, 74, 90])
    df = spark.createDataFrame([(1, 0, 4, int(v)) for v in y], "shot long, frame long, x long, y long")
    got = pattern.order_spacing(pattern.number_peaks(df)).orderBy("ord").toPandas()
    want = np.gradient(y.astype(float))
    assert np.allclose(got.spacing, want)
    i = np.arange(len(y))
    assert np.allclose(got.smooth_spacing, np.polyval(np.polyfit(i, want, 4), i))


def test_banded_solvers_against_dense_ones():
    rng = np.random.default_rng(4)
    for n in (3, 4, 5, 40):
        bend = np.diff(np.eye(n), 2, axis=0)
        w, y = rng.random(n) + 0.1, rng.normal(size=n)
        full = np.diag(w) + 7.0 * bend.T @ bend
        far = np.diag(full, 2)
        assert np.allclose(solver.solve_five(np.diag(full), np.diag(full, 1), far, y), np.linalg.solve(full, y))
    for n in (4, 5, 9, 100_000):
        x = np.cumsum(rng.random(n) + 0.1) / n
        m = solver.spline_second_derivatives(x, x**3 - 2 * x**2)
        assert np.allclose(m, 6 * x - 4, atol=1e-4 if n < 100 else 1e-2)


def test_ten_thousand_point_baseline_needs_little_memory():
    x = np.linspace(0, 1, 10_000)
    curve, _ = solver.smooth_below(1 + x + np.exp(-((x - 0.5) / 0.001) ** 2), 1e10, 1e-5, 10)
    assert len(curve) == 10_000 and np.isfinite(curve).all()


def test_every_fit_keeps_its_key(spark):
    from spectralake.operators import bands as b
    rows = [(1, 0, "a", 600.0 + i / 10, i, None if i == 3 else 5 * float(np.exp(-2 * (i - 5.0) ** 2))) for i in range(12)]
    rows += [(1, 1, "a", 600.0 + i / 10, i, -1.0) for i in range(12)] + [(1, 2, "a", 600.0, 0, None), (1, 3, "a", 600.0, 0, 2.0)]
    slices = spark.createDataFrame(rows, "shot long, frame long, band string, wl double, seq long, y double")
    ratios = spark.createDataFrame([("a", 0, 600.5, 0.0, 1.0)], "band string, line long, wl0 double, offset double, ratio double")
    got = {r.frame: r for r in b.fit_bands(slices, ratios).collect()}
    assert set(got) == {0, 1, 2, 3} and abs(got[0].centre - 600.5) < 1e-3 and got[0].converged
    assert all(got[f].delta is None or got[f].delta != got[f].delta for f in (1, 2, 3))
    assert {r.frame: r.intensity for r in b.integrate(slices).collect() if r.frame != 1} == {0: None, 2: None, 3: 0.0}


def test_missing_cells_keep_their_place_in_text(spark):
    from spectralake.sinks import text
    from spectralake.sources import tables
    pattern = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 0, None), (1, 2, 0, 17), (1, 0, 1, 6), (1, 2, 1, 18)], "cal_id long, ord long, x long, yc long")
    lines = [r.text for r in text.pattern_lines(pattern).orderBy("line").collect()]
    assert lines == ["5 nan 17", "6 nan 18"]
    whole = spark.createDataFrame([("\n".join(lines), 1)], "value string, cal_id long")
    back = {(r.ord, r.x): r.yc for r in tables.parse_pattern(whole).collect()}
    assert back == {(0, 0): 5, (1, 0): None, (2, 0): 17, (0, 1): 6, (1, 1): None, (2, 1): 18}
    spectra = spark.createDataFrame([(1, f, 0, 600.0, 1.0 + f) for f in (0, 2)], "shot long, frame long, pos long, wl double, wm double")
    shots = spark.createDataFrame([(1, 3, 0.1, 0.2, 0.3)], "shot long, n_frames long, cycle_s double, exposure_s double, trig_delay_s double")
    data = text.spectra_lines(spectra, shots, "wm", "n", "d").where("part = 1").first().text
    assert data == "600.000000, 1.000000e+00, nan, 3.000000e+00"
