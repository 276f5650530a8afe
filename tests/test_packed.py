"""Spectra as arrays against the same steps on rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.operators import background, bands, extraction, packed
from spectralake.plans import calibration, products
from spectralake.storage import attach, save

WIDTH, HEIGHT, FRAMES = 40, 20, 6


@pytest.fixture(scope="module")
def world(spark):
    """Images with missing pixels, a lost row and a lost frame; two sets, two orders."""
    rng = np.random.default_rng(4)
    rows = []
    for shot, n in ((1, FRAMES), (2, 3), (3, 1)):
        for frame in range(n):
            for y in range(HEIGHT):
                row = [None if rng.random() < 0.02 else float(v) for v in rng.integers(0, 50, WIDTH)]
                if frame == n - 1 and n > 1:
                    row = [v and v + 300 * (x == 7) for x, v in enumerate(row)]
                if (shot, frame, y) not in ((1, 2, 3),) and (shot, frame) != (2, 1):
                    rows.append((shot, frame, y, shot % 2, row))
    random.Random(1).shuffle(rows)
    frames = spark.createDataFrame(rows, "shot long, frame long, y long, cal_id long, row array<double>").repartition(3)
    pattern = spark.createDataFrame([(c, o, x, 3 + 8 * o + x // 15 + c) for c in range(2) for o in range(2) for x in range(WIDTH)],
                                    "cal_id long, ord long, x long, yc long")
    runs = extraction.sensor_runs(pattern, 2, HEIGHT)
    pixels = [(c, o, x, 700.0 - 12 * o - 0.4 * x - c, 0) for c in range(2) for o in range(2) for x in range(5, WIDTH - 3)]
    pixels = [(*p[:4], i % 64, 0.5 + 0.1 * p[1]) for i, p in enumerate(pixels)]
    table = save(spark.createDataFrame(pixels, "cal_id long, ord long, x long, wl double, seq long, f_wm double"))
    shots = save(spark.createDataFrame([(1, FRAMES, 0.5), (2, 3, 2.0), (3, 1, 1.0)], "shot long, n_frames long, exposure_s double"))
    cal = calibration.Calibration(runs, table)
    return frames, cal, shots, save(products.stitched(frames, cal))


def rows_of(df, *columns):
    return {tuple(r[:-1]): r[-1] for r in df.select(*columns).collect()}


def close(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, rel=1e-9, abs=1e-9)), k


def test_order_sums(world):
    frames, cal, _, _ = world
    key = ["shot", "frame", "ord", "x", "counts"]
    got = packed.frame_sums(frames, cal.row_runs).select("shot", "frame", "ord", F.posexplode("counts").alias("x", "counts"))
    want = rows_of(extraction.order_spectra(frames, cal.runs), *key)
    assert rows_of(got.where("counts is not null"), *key) == {k: v for k, v in want.items() if v is not None}
    assert any(v is None for v in want.values()) or got.where("counts is null").count() >= 0


def stitched_rows(world):
    frames, cal, _, _ = world
    return attach(extraction.order_spectra(frames, cal.runs), cal.pixels, ["cal_id", "ord", "x"]).where("counts is not null")


def test_stitched_and_calibrated(world):
    frames, cal, shots, spectra = world
    rows = save(stitched_rows(world))
    key = ["shot", "frame", "ord", "x", "wl", "seq"]
    close(rows_of(packed.unpacked(spectra, ["counts"], ("x", "wl", "seq")), *key, "counts"), rows_of(rows, *key, "counts"))
    wm = rows.join(shots, "shot").withColumn("wm", F.col("counts") * F.col("f_wm") / F.col("exposure_s"))
    close(rows_of(packed.unpacked(packed.calibrate(spectra, shots), ["counts", "wm"]), "shot", "frame", "ord", "x", "wm"),
          rows_of(wm, "shot", "frame", "ord", "x", "wm"))


def test_background(world):
    _, _, shots, spectra = world
    rows = save(stitched_rows(world))
    for k in (1.0, 2.5, 100.0):
        quiet, plain = packed.quiet_frames(spectra, k), background.quiet_frames(rows, k)
        assert rows_of(quiet, "shot", "frame", "quiet") == rows_of(plain, "shot", "frame", "quiet")
        for column in ("top", "mean", "sd"):
            close(rows_of(quiet, "shot", "frame", column), rows_of(plain, "shot", "frame", column))
        runs = save(background.longest_run(quiet.where("shot <> 2")))
        level = save(packed.background_level(spectra, runs))
        net = packed.subtract_level(spectra, level, shots)
        got = net.select("shot", "frame", "ord", F.explode(F.arrays_zip("px", "counts")).alias("p"), "background").select(
            "shot", "frame", "ord", "p.px.x", "p.counts", "background")
        want = background.subtract_background(rows, runs, shots, keys=("ord", "x"))
        for column in ("counts", "background"):
            given = rows_of(got, "shot", "frame", "ord", "x", column)
            plain_ = rows_of(want, "shot", "frame", "ord", "x", column)
            close({k: given[k] for k in plain_}, plain_)


def test_bands(spark, world):
    _, cal, shots, spectra = world
    rows = save(stitched_rows(world).join(shots, "shot").withColumn("wm", F.col("counts") * F.col("f_wm") / F.col("exposure_s")))
    table = spark.createDataFrame([("a", 692.0, 695.0), ("over", 683.0, 689.0), ("narrow", 690.05, 690.1), ("none", 100.0, 101.0)],
                                  "band string, lo double, hi double")
    cut = bands.band_slices(rows, table, pad=1.0)
    complete = packed.calibrate(spectra, shots).where("shot = 3")
    segments = save(packed.band_segments(cal.orders, table, 1.0))
    got = packed.band_slices(packed.calibrate(spectra, shots), segments)
    key = ["shot", "frame", "band", "wl", "seq", "core", "y"]
    there = packed.points_of(got).where("y is not null")
    assert rows_of(there, *key[:5], "y").keys() == rows_of(cut, *key[:5], "y").keys()
    close(rows_of(there, *key[:5], "y"), rows_of(cut, *key[:5], "y"))
    line = packed.subtract_line(got)
    lost = {(r.shot, r.frame, r.band) for r in packed.points_of(got).where("y is null").collect()}
    want = {k: v for k, v in rows_of(bands.subtract_line(cut), "shot", "frame", "band", "wl", "y").items() if k[:3] not in lost}
    have = {k: v for k, v in rows_of(packed.points_of(line), "shot", "frame", "band", "wl", "y").items() if k[:3] not in lost}
    close(have, want)
    areas = rows_of(packed.integrate(line), "shot", "frame", "band", "intensity")
    plain = rows_of(bands.integrate(bands.subtract_line(cut)), "shot", "frame", "band", "intensity")
    close({k: v for k, v in areas.items() if k not in lost}, {k: v for k, v in plain.items() if k not in lost})
    hit = {k[:3] for k, v in rows_of(packed.points_of(line), "shot", "frame", "band", "wl", "y").items() if v is None}
    assert {k for k, v in areas.items() if v is None} == hit
    assert complete.count() == 2


def test_segments_where_wavelength_turns(spark):
    px = [(x, 500.0 + abs(x - 10), x) for x in range(21)]
    orders = spark.createDataFrame([(1, 0, px)], "cal_id long, ord long, px array<struct<x:long,wl:double,seq:long>>")
    table = spark.createDataFrame([("b", 503.0, 505.0)], "band string, lo double, hi double")
    spectra = orders.select(F.lit(1).cast("long").alias("shot"), F.lit(0).cast("long").alias("frame"), "cal_id", "ord", "px",
                            F.transform("px", lambda p: p["x"].cast("double")).alias("wm"))
    got = packed.band_slices(spectra, save(packed.band_segments(orders, table, 0.0)))
    assert sorted(p.y for p in got.first().points) == [5, 6, 7, 13, 14, 15]


def test_one_exchange_from_images_to_intensities(spark, world):
    frames, cal, shots, _ = world
    table = spark.createDataFrame([("a", 692.0, 695.0), ("over", 683.0, 689.0)], "band string, lo double, hi double")
    spectra = packed.calibrate(products.stitched(frames, cal), shots)
    values = packed.integrate(products.band_points(spectra, cal, table, 1.0))
    plan = values._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line and "RoundRobin" not in line]
    assert len(moved) == 1 and "hashpartitioning(shot" in moved[0] and "REPARTITION" in moved[0], plan
    assert "Window" not in plan
