"""Operators against brute force on small fixtures."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectralake.operators import absolute, background, bands, extraction, frames, pattern, shots, wavelength
from spectralake.plans import calibration, products
from spectralake.sinks import text
from spectralake.sources import catalogue, tables
from spectralake.sources import shots as source
from spectralake.storage import attach, save
from spectralake.streaming import arrivals, completeness

PROFILE = "shot long, frame long, x long, y long, counts long"


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def stack(spark, image, shot=1, frame=0, cal_id=0):
    return spark.createDataFrame(
        [(shot, frame, y, [int(v) for v in row], cal_id) for y, row in enumerate(image)],
        "shot long, frame long, y long, row array<long>, cal_id long")


def to_image(df):
    got = source.pixels(df).toPandas()
    return got.pivot(index="y", columns="x", values="counts").to_numpy()


def test_shot_numbers_and_copies(spark):
    t = datetime.datetime
    files = spark.createDataFrame([
        ("file:/d/12_image.SIF", t(2024, 1, 1)), ("file:/d/b/12_image.SIF", t(2024, 1, 2)),
        ("file:/d/dark.SIF", t(2024, 1, 1)), ("file:/d/7.SIF", t(2024, 1, 1))], "path string, modificationTime timestamp")
    assert rows_of(source.index_shots(files), "shot", "path") == [
        (7, "file:/d/7.SIF"), (12, "file:/d/b/12_image.SIF")]
    assert rows_of(source.unnumbered(files), "path") == [("file:/d/dark.SIF",)]


def test_listing_decoding_and_frame_store(spark, tmp_path):
    for shot in (31, 32):
        body = json.dumps([[[shot + f, y, x] for y in range(2) for x in [0]] for f in range(2)])
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{shot}_image.SIF").write_text(body)
    (tmp_path / "in" / "notes.txt").write_text("x")

    def decoder(path, content):
        import json as j
        shot = int(path.split("/")[-1].split("_")[0])
        for f, frame in enumerate(j.loads(content)):
            for y, row in enumerate(frame):
                yield shot, f, y, [float(v) for v in row]

    listed = source.index_shots(source.list_files(spark, str(tmp_path / "in")))
    assert rows_of(source.shot_range(listed), "first_shot", "last_shot") == [(31, 32)]
    scanned = source.scan_frames(spark, str(tmp_path / "in"), decoder)
    store = str(tmp_path / "store")
    source.write_frames(scanned, store)
    back = source.read_frames(spark, store)
    assert back.count() == 8
    one = shots.lookup(back, 32)
    assert rows_of(one.where("frame = 1 and y = 0"), "row") == [([33.0, 0.0, 0.0],)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shot" in plan
    assert shots.is_empty(shots.lookup(listed, 99))


def test_line_list_text(spark):
    lines = spark.createDataFrame([(v,) for v in (
        "#Th spectrum", "#order from to center wavelength band", "", "0\t0225\t0238\t231.2193\t794.81764\tArI",
        "0  0240  0260  250.5985  794.31814  NeI  # weak", "#1\t1\t2\t3\t4", "   ", "1\t10\t20\t35.5\t700.25")], "value string")
    got = tables.parse_line_list(lines)
    assert rows_of(got, "ord", "px", "wl") == [(0, 231.2193, 794.81764), (0, 250.5985, 794.31814), (1, 35.5, 700.25)]
    assert [r.species for r in got.orderBy("px").collect()] == [None, "ArI", "NeI"]


def test_pattern_text_keeps_line_order(spark, tmp_path):
    path = tmp_path / "pattern.txt"
    path.write_text("".join(f"{x} {x + 10}\n" for x in range(50)))
    got = tables.read_pattern(spark, str(path), 3)
    assert rows_of(got, "cal_id", "ord", "x", "yc") == sorted((3, o, x, x + 10 * o) for o in range(2) for x in range(50))


def test_frame_geometry(spark):
    image = np.arange(20).reshape(4, 5) * 3 % 11
    df = stack(spark, image)
    dims = save(spark.createDataFrame([(1, 4, 2, 3)], "shot long, dim_o long, xbin long, ybin long"))
    assert (to_image(frames.crop(df, dims)) == image[0:-1]).all()
    assert (to_image(frames.crop(df, dims, -3, 4)) == image[-3:4]).all()
    assert (to_image(frames.unbin(df, dims)) == image.repeat(3, axis=0).repeat(2, axis=1)).all()
    assert (to_image(frames.subtract_min(df)) == image - image.min()).all()
    want = image.copy()
    for x in range(5):
        y0, y1 = max(0, int(0.5 * x - 1)), max(0, int(0.5 * x + 1.6))
        want[y1:, x] = image.min()
        want[:y0, x] = image.min()
    assert (to_image(frames.blank_outside(df, 0.5, -1.0, 1.6)) == want).all()
    low, high = np.percentile(image, [1, 99])
    r = frames.contrast(source.pixels(df)).first()
    assert (r.low, r.high) == pytest.approx((low, high))
    with pytest.raises(ValueError, match="wrong dark image size"):
        one = spark.createDataFrame([(1, 4, 4, 1, 1)], "cal_id long, dim_w long, dim_o long, xbin long, ybin long")
        frames.check_dims(one, one.withColumn("ybin", F.lit(2)))


def greedy(y, v, thres, dist):
    level = thres * (v.max() - v.min()) + v.min()
    steps = [i for i in range(len(v)) if i == 0 or v[i] != v[i - 1]]
    tops = [b for a, b, c in zip(steps, steps[1:], steps[2:]) if v[b] > v[a] and v[b] > v[c] and v[b] > level]
    kept = []
    for t in sorted(tops, key=lambda i: (v[i], i), reverse=True):
        if all(abs(t - k) > dist for k in kept):
            kept.append(t)
    return sorted(kept)


@pytest.mark.parametrize("seed", [0, 1])
def test_peaks_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    data = {x: rng.integers(0, 12, 80) for x in range(6)}
    df = spark.createDataFrame([(1, 0, x, y, int(c)) for x, v in data.items() for y, c in enumerate(v)], PROFILE)
    got = pattern.greedy_peaks(pattern.local_peaks(df, 0.13), 4)
    for x, v in data.items():
        assert [r.y for r in got.where(F.col("x") == x).orderBy("y").collect()] == greedy(None, v, 0.13, 4)


def brute_spectra(image, centres, dv):
    height = image.shape[0]
    out = {}
    for o, yc in enumerate(centres):
        for x in range(image.shape[1]):
            if yc[x] + dv > height - 1:
                break
            rows = [y for y in range(yc[x] - dv, yc[x] + dv + 1) if y >= 0]
            out[o, x] = int(image[rows, x].sum())
    return out


def test_order_sums_against_brute_force(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 1000, (30, 40))
    # the last order leaves the sensor and returns; the first dips under row 0
    centres = np.array([[1 + x // 20 for x in range(40)], [10 + (x * x) // 400 for x in range(40)],
                        [25 + (4 if 15 <= x < 20 else 0) for x in range(40)]])
    p = spark.createDataFrame([(0, o, x, int(c)) for o, row in enumerate(centres) for x, c in enumerate(row)],
                              "cal_id long, ord long, x long, yc long")
    got = {(r.ord, r.x): r.counts for r in extraction.extract(stack(spark, image), p, 2, 30).collect()}
    assert got == brute_spectra(image, centres, 2)
    mask = extraction.truncate_mask(p, 2, 30)
    short = extraction.short_orders(p, 2, 30, 40)
    assert rows_of(short, "ord", "x_missing") == [(2, 15)]
    padded = extraction.pad_orders(extraction.extract(stack(spark, image), p, 2, 30), 40)
    assert padded.count() == 120 and padded.where("counts is null").count() == 25
    runs = extraction.sensor_runs(p, 2, 30)
    unfolded = runs.select("ord", "y", F.explode(F.sequence("x_from", F.col("x_from") + F.col("n") - 1)).alias("x"))
    assert rows_of(unfolded, "ord", "y", "x") == rows_of(mask, "ord", "y", "x")
    touching = runs.alias("a").join(runs.alias("b"), F.expr("a.ord = b.ord and a.y = b.y and a.x_from + a.n = b.x_from"))
    assert touching.count() == 0


def test_single_peaks_and_orders_off_the_sensor_stay(spark):
    peaks = spark.createDataFrame([(0, 0, 5, 12), (0, 0, 6, 5), (0, 0, 6, 15)], "shot long, frame long, x long, y long")
    spacing = pattern.order_spacing(pattern.number_peaks(peaks))
    assert rows_of(spacing, "x", "ord", "y", "spacing", "smooth_spacing")[0] == (5, 0, 12, None, None)
    profiles = spark.createDataFrame([(0, 0, x, y, y * y) for x in (5, 6) for y in range(25)], "shot long, frame long, x long, y long, counts long")
    shape = pattern.order_profile(profiles, spacing, 25)
    assert rows_of(shape.where("x = 5"), "ord", "dy", "z") == [(0, None, None)] and shape.where("x = 6").count() > 2
    assert pattern.fit_profile(shape).where("x = 5 and centre is null").count() == 1
    image = np.ones((30, 40), int)
    p = spark.createDataFrame([(0, o, x, yc) for o, yc in ((0, 10), (1, 50)) for x in range(40)], "cal_id long, ord long, x long, yc long")
    rows = stack(spark, image)
    padded = extraction.pad_orders(extraction.extract(rows, p, 2, 30), 40, rows, p)
    assert padded.count() == 80 and padded.where("ord = 1 and counts is null").count() == 40


def test_a_set_outside_the_lamp_table_is_flagged(spark, monkeypatch):
    points = spark.createDataFrame([(c, 0, x, w) for c, w in ((1, 500.0), (2, 900.0)) for x in range(3)], "cal_id long, ord long, x long, wl double")
    knots = spark.createDataFrame([(c, u / 10, 1.0 + u) for c in (1, 2) for u in range(4, 9)], "cal_id long, um double, mw double")
    sums = points.selectExpr("cal_id", "ord", "x", "5 as sphere", "1 as dark")
    for name, table in (("wavelengths", points), ("stitched_pixels", points), ("image_sums", sums)):
        monkeypatch.setattr(calibration, name, lambda *_, table=table: table)
    monkeypatch.setattr(calibration.extraction, "sensor_runs", lambda *_: points)
    exposures = spark.createDataFrame([(1, 0.5), (2, 0.5)], "cal_id long, exposure_s double")
    for cubic in (False, True):
        made = calibration.calibrate(None, None, None, 2, 3, 30, knots, exposures, cubic)
        assert rows_of(made.outside, "cal_id", "n") == [(2, 3)]
        assert made.pixels.where("cal_id = 1 and f_wm > 0").count() == 3 and made.pixels.where("cal_id = 2 and f_wm is null").count() == 3


@pytest.mark.parametrize("orders", [(0, 1, 2), (3, 5, 9)])
@pytest.mark.parametrize("sign", [-1, 1])
def test_crossings_and_borders_in_both_directions(spark, sign, orders):
    # order k covers 20 k .. 20 k + 40 nm in 41 columns of 1 nm; its lamp is a straight line
    # that falls on even and rises on odd places, so neighbours cross where the lines meet:
    # 100 - (w - 20 k) = 70 + (w - 20 k - 20) at w = 20 k + 25 for even k, and by symmetry
    # 70 + (w - 20 k) = 100 - (w - 20 k - 20) at w = 20 k + 25 for odd k
    start = lambda k, i: 600.0 + sign * 20 * k + sign * i
    lamp = lambda k, i: 100.0 - i if k % 2 == 0 else 70.0 + i
    rows = [(4, o, i, start(k, i), lamp(k, i)) for k, o in enumerate(orders) for i in range(41)]
    both = spark.createDataFrame(rows, "cal_id long, ord long, x long, wl double, counts double")
    w, sp = both.select("cal_id", "ord", "x", "wl"), both.select("cal_id", "ord", "x", "counts")
    turn = wavelength.direction(w)
    assert turn.first().direction == sign
    cross = wavelength.order_crossings(w, sp)
    # the grid has as many places as the second order has points, half a nanometre apart
    want = [(orders[0], orders[1], 600.0 + sign * 25), (orders[1], orders[2], 600.0 + sign * 45)]
    assert rows_of(cross, "ord", "next_ord", "cross") == [(a, b, pytest.approx(c, abs=0.26)) for a, b, c in want]
    got = {r.ord: (r.x_from, r.x_to, r.trimmed) for r in wavelength.order_borders(w, cross, turn, 41).collect()}
    # column 25 of an order is its crossing with the next, column 5 of the next is the same
    # wavelength: rising, an order ends past the first column beyond it and the next starts on it;
    # falling, the roles of the two sides of the border are taken by column 24
    last, first = (27, 5) if sign > 0 else (25, 5)
    assert got == {orders[0]: (0, last, True), orders[1]: (first, last, True), orders[2]: (first, 41, True)}


def test_orders_without_overlap_are_flagged(spark):
    w = spark.createDataFrame([(1, o, x, 700.0 - 100 * o - x) for o in range(2) for x in range(20)],
                              "cal_id long, ord long, x long, wl double")
    sp = w.select("cal_id", "ord", "x", F.lit(5.0).alias("counts"))
    cross = wavelength.order_crossings(w, sp)
    assert [r.cross for r in cross.collect()] == [None]
    borders = wavelength.order_borders(w, cross, wavelength.direction(w), 20)
    assert rows_of(borders, "ord", "x_from", "x_to", "trimmed") == [(0, 0, 20, False), (1, 0, 20, False)]


def brute_run(flags):
    best, start = None, None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            if best is None or i - start > best[1] - best[0] + 1:
                best = (start, i - 1)
            start = None
    return best


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_longest_run_is_independent_of_blocks(spark, block):
    rng = np.random.default_rng(11)
    data = {s: rng.random(40) < q for s, q in enumerate([0.3, 0.7, 0.95, 1.1, -1.0])}
    df = spark.createDataFrame([(s, f, bool(v)) for s, flags in data.items() for f, v in enumerate(flags)],
                               "shot long, frame long, quiet boolean")
    got = {r.shot: (r.run_first, r.run_last) for r in background.longest_run(df, block).collect()}
    assert got == {s: brute_run(f) for s, f in data.items() if brute_run(f)}


def test_background_of_single_and_restless_shots(spark):
    rows = [(1, 0, 0, 0, 7)] + [(2, f, 0, x, 100 * (x == f)) for f in range(3) for x in range(3)]
    s = spark.createDataFrame(rows, "shot long, frame long, ord long, x long, counts long")
    runs = save(background.longest_run(background.quiet_frames(s, 1.0).where("shot = 2")))
    counts = save(s.groupBy("shot").agg((F.max("frame") + 1).alias("n_frames")))
    got = background.subtract_background(s, runs, counts)
    assert rows_of(got.where("shot = 1"), "counts", "background") == [(7.0, True)]
    assert got.where("shot = 2 and counts is null and not background").count() == 9
    summary = background.background_summary(counts, runs)
    assert rows_of(summary, "shot", "background") == [(1, "None"), (2, "None")]


def test_catalogue(spark):
    lines = catalogue.band_lines(spark)
    assert lines.count() == 43 and lines.select("band").distinct().count() == 23
    g = {(r.band, r.line): r.g for r in bands.stat_weights(lines).collect()}
    assert g["CIV-444", 1] == 6 and g["CIV-465", 0] == 18 and g["He-504", 0] == 1 and g["CIV-547", 3] == 30
    b = {r.band: (r.lo, r.hi) for r in bands.band_bounds(
        lines, catalogue.bound_overrides(spark), catalogue.band_centres(spark)).collect()}
    assert len(b) == 24 and b["CIV-580"] == (579.95, 580.35) and b["CHD-band"] == (429.0, 431.5)
    assert b["CIV-444"] == pytest.approx((443.6, 444.6)) and b["He-447"] == pytest.approx((446.85, 447.45))
    fit = catalogue.bands_in(lines, catalogue.band_groups(spark), *catalogue.FITTED_GROUPS)
    assert fit.select("band").distinct().count() == 16
    ratio = {(r.band, r.line): r.ratio for r in bands.line_ratios(lines).collect()}
    assert ratio["H-beta", 0] == 0.06 and ratio["H-beta", 1] == 1 and ratio["CIV-580", 0] == 1
    assert ratio["CIV-444", 1] == pytest.approx(1.05e8 * 6 / (8.72e7 * 4))


def test_endpoint_line_keeps_its_quirk(spark):
    rng = np.random.default_rng(2)
    wl, y = np.linspace(500, 501, 30), rng.normal(5, 1, 30)
    core = (wl >= 500.2) & (wl <= 500.8)
    df = spark.createDataFrame([(1, 0, "b", float(a), i, float(b), bool(c)) for i, (a, b, c) in enumerate(zip(wl, y, core))],
                               "shot long, frame long, band string, wl double, seq long, y double, core boolean")
    c1, c2, d1, d2 = y[:5].mean(), y[-5:].mean(), wl[:5].mean(), wl[-5:].mean()
    a = (c2 - c1) / (d2 - d1)
    want = (y - (a * wl + (c1 - a * wl[0])))[core]
    got = bands.subtract_line(df).orderBy("wl").toPandas()
    assert np.allclose(got.y, want)
    area = bands.integrate(bands.subtract_line(df)).first().intensity
    assert area == pytest.approx(np.trapezoid(want, wl[core]))


def test_band_slices_do_not_depend_on_the_cell(spark):
    s = spark.createDataFrame([(1, 0, 400 + i * 0.037, i, float(i)) for i in range(400)],
                              "shot long, frame long, wl double, seq long, wm double")
    table = spark.createDataFrame([("a", 402.0, 404.5), ("b", 404.0, 404.2), ("c", 300.0, 301.0)], "band string, lo double, hi double")
    want = [(b, i) for b, lo, hi in (("a", 402.0, 404.5), ("b", 404.0, 404.2)) for i in range(400)
            if lo - 0.1 <= 400 + i * 0.037 <= hi + 0.1]
    for cell in (0.05, 1.0, 50.0):
        assert rows_of(bands.band_slices(s, table, cell=cell), "band", "seq") == sorted(want)


def test_join_is_the_same_with_and_without_broadcast(spark):
    fact = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    dim = save(spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    assert rows_of(attach(fact, dim, ["k"]), "id", "v") == rows_of(attach(fact, dim, ["k"], max_rows=1), "id", "v")


def test_text_files(spark, tmp_path):
    s = spark.createDataFrame([(9, f, p, 500.5 + p, None if (f, p) == (1, 1) else f * 10.0 + p) for f in range(2) for p in range(3)],
                              "shot long, frame long, pos long, wl double, wm double")
    meta = spark.createDataFrame([(9, 2, 0.5, 0.25, 2.75)], "shot long, n_frames long, cycle_s double, exposure_s double, trig_delay_s double")
    lines = text.spectra_lines(s, meta, "wm", "Spectra", "01/01/2025 00:00")
    text.write_lines(lines, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "shot=9").glob("*.txt"))
    body = "".join(p.read_text() for p in parts).splitlines()
    assert body[11] == "# ValName = '0','1'" and body[12] == "# ValUnit = 'W/(m2 nm)','W/(m2 nm)'"
    assert body[15] == "# time = 2.75 + frameNo*0.5 (s)" and body[18] == "# [Data]"
    assert body[19] == "500.500000, 0.000000e+00, 1.000000e+01"
    assert body[20] == "501.500000, 1.000000e+00, nan"
    text.write_spectra(s.withColumnRenamed("pos", "seq"), str(tmp_path / "spec"))
    done = text.written_shots(spark, str(tmp_path / "spec"), "frame long, seq long, wl double, wm double, shot long")
    every = spark.createDataFrame([(9,), (10,)], "shot long")
    assert rows_of(shots.pending(every, done), "shot") == [(10,)]
    assert shots.pending(every, done, overwrite=True).count() == 2


def test_stream_takes_up_a_shot_once_it_is_complete(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "shot long, frame long, y long"
    part = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    expected = save(spark.createDataFrame([(1, 2, 2), (2, 1, 3)], "shot long, n_frames long, height long"))
    count = lambda df: df.groupBy("shot").agg(F.count("*").alias("n"))

    def step(keep_ms=10**9):
        stream = arrivals.arriving_rows(spark, folder, spark.createDataFrame([], schema).schema)
        query = arrivals.process_arrivals(stream, expected, count, out, keep_ms=keep_ms)
        query.awaitTermination()
        held = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) if query.lastProgress else None
        return rows_of(arrivals.results(spark, out, "shot long, n long"), "shot", "n"), held

    part([(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 0, 1), (1, 7, 0), (9, 0, 0)])
    assert step()[0] == []
    part([(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 1), (2, 0, 0)])      # sent again: as many rows as shot 2 needs
    assert step()[0] == []
    part([(1, 1, 1)])
    assert step()[0] == [(1, 4)]
    part([(1, 1, 1), (2, 0, 2)])
    done, held = step()
    assert done == [(1, 4), (2, 3)] and held
    part([(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)])                 # all of it once more
    assert step()[0] == [(1, 4), (2, 3)]


def test_state_of_what_is_done_or_stale_is_dropped(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "shot long, frame long, y long"
    expected = save(spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 1, 3)], "shot long, n_frames long, height long"))
    rows = [[(1, 0, 0), (1, 0, 1), (3, 0, 0)], [(2, 0, 0)], [(2, 0, 1)], [(3, 0, 1), (3, 0, 2)]]
    for some in rows:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = completeness.complete_shots(stream, expected, keep_ms=1).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.schema("shot long, n_frames long, arrived timestamp").parquet(out)
    assert rows_of(found, "shot") == [(1,)]        # shot 3 forgot its first rows before its last one came
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 4


def test_fitted_intensities_replace_integrals_only_where_a_line_stands_out(spark):
    wl = [float(w) for w in np.linspace(579.8, 580.5, 60)]
    pixels = spark.createDataFrame([(1, 0, i, w, i) for i, w in enumerate(wl)], "cal_id long, ord long, x long, wl double, seq long")
    cal = calibration.Calibration(None, pixels)
    rows = []
    for f, area in ((0, 0.05), (1, 0.05), (2, 0.0001)):
        y = area / (np.sqrt(2 * np.pi) * 0.03) * np.exp(-((np.array(wl) - 580.131) ** 2) / (2 * 0.03**2))
        rows.append((1, f, 1, 0, [float(v) for v in y]))
    s = spark.createDataFrame(rows, "shot long, frame long, cal_id long, ord long, wm array<double>").join(cal.orders, ["cal_id", "ord"])
    table = spark.createDataFrame([("CIV-580", 579.95, 580.35)], "band string, lo double, hi double")
    meta = save(spark.createDataFrame([(1, 3)], "shot long, n_frames long"))
    got = products.intensities(s, cal, table, meta, catalogue.band_lines(spark), fitted=["CIV-580"])
    values = {r.frame: r.intensity for r in got.collect()}
    assert set(values) == {1, 2} and values[1] == pytest.approx(0.05, rel=2e-2)


def test_units_and_labels(spark):
    s = spark.createDataFrame([(1, 0, 0, 5, 10, 1.0, 2.0, 3.0)],
                              "shot long, frame long, ord long, x long, counts long, wm double, wmsr double, phmsr double")
    assert absolute.select_unit(s, "wmsr").first().label == "W/(m2 sr nm)"
    assert rows_of(absolute.unpivot_units(s), "unit", "value") == [("counts", 10.0), ("phmsr", 3.0), ("wm", 1.0), ("wmsr", 2.0)]
