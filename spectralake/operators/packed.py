"""Spectra as arrays: one row per order of a frame, from images to band intensities.

``(shot, frame, cal_id, ord, counts)`` holds the sums of an order's columns as one array,
and ``(cal_id, ord, px)`` its calibration: the columns of its own segment with
wavelength, position and factors. They meet in one join of few rows, and what follows is
array arithmetic within a row; pixels become rows again only in ``unpacked``.

A task adds up the image rows of a frame as they stream by and hands on one array per
order, so the only exchange from images to band intensities carries packed order sums, by
``(shot, frame)``; all later groupings are finer than that and stay where they are. A
column without any image row, or with missing pixels only, is NULL.
"""

from pyspark.sql import functions as F

from spectralake.storage import attach

ARRAY_BYTES = 48 << 10      # taken for a packed row when a join is chosen: a segment with its factors
FACTORS = ("f_wm", "f_wmsr", "f_phmsr")


def pack_runs(runs):
    """Mask stretches of each image row as one array."""
    return runs.groupBy("cal_id", "y").agg(F.collect_list(F.struct("ord", "x_from", "n")).alias("runs"))


def frame_sums(frame_rows, runs):
    """Order sums of every frame; ``runs`` is ``pack_runs``, saved.

    Tasks add up image rows in numpy as long as the frame stays the same. Rows of a frame
    that lie apart give several arrays, which are added after the exchange.
    """
    import numpy as np
    import pyarrow as pa

    def added(batches):
        key, totals, found = None, {}, {}

        def handed():
            orders = sorted(totals)
            arrays = pa.array([pa.array(totals[o], mask=~found[o]) for o in orders], pa.list_(pa.float64()))
            keys = [pa.array([k] * len(orders), pa.int64()) for k in key]
            return pa.RecordBatch.from_arrays([*keys, pa.array(orders, pa.int64()), arrays], ["shot", "frame", "cal_id", "ord", "counts"])

        for batch in batches:
            shots, frames, sets = (batch.column(i).to_pylist() for i in range(3))
            rows, runs_of = batch.column("row"), batch.column("runs")
            values, at = rows.flatten().cast(pa.float64()), np.asarray(rows.offsets) - rows.offsets[0].as_py()
            here = None if not values.null_count else np.asarray(values.is_valid())
            pixels = np.nan_to_num(values.to_numpy(zero_copy_only=False)) if values.null_count else values.to_numpy()
            stretches = runs_of.flatten()
            ords, starts, sizes = (stretches.field(f).to_pylist() for f in ("ord", "x_from", "n"))
            ends = np.asarray(runs_of.offsets) - runs_of.offsets[0].as_py()
            for i in range(len(batch)):
                if key != (shots[i], frames[i], sets[i]):
                    if totals:
                        yield handed()
                    key, totals, found = (shots[i], frames[i], sets[i]), {}, {}
                row = pixels[at[i]:at[i + 1]]
                for k in range(ends[i], ends[i + 1]):
                    o, a, b = ords[k], starts[k], starts[k] + sizes[k]
                    if o not in totals:
                        totals[o], found[o] = np.zeros(len(row)), np.zeros(len(row), bool)
                    part = row[a:b]
                    totals[o][a:a + len(part)] += part
                    found[o][a:a + len(part)] |= True if here is None else here[at[i] + a:at[i] + a + len(part)]
        if totals:
            yield handed()

    rows = attach(frame_rows, runs, ["cal_id", "y"], row_bytes=4096).select("shot", "frame", "cal_id", "row", "runs")
    parts = rows.mapInArrow(added, "shot long, frame long, cal_id long, ord long, counts array<double>")
    # as many partitions as a store has buckets, so that writing one moves nothing again
    n = int(frame_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = parts.repartition(n, "shot", "frame").groupBy("shot", "frame", "cal_id", "ord").agg(F.collect_list("counts").alias("parts"))
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x + y, x, y))
    return lists.select("shot", "frame", "cal_id", "ord", F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0], both).alias("counts"))


def pack_pixels(pixels):
    """Stitched pixels ``(cal_id, ord, x, wl, seq, ...)`` as one array per order, by column."""
    rest = [c for c in pixels.columns if c not in ("cal_id", "ord")]
    ordered = F.array_sort(F.collect_list(F.struct("x", *[c for c in rest if c != "x"])))
    return pixels.groupBy("cal_id", "ord").agg(ordered.alias("px"))


def stitch(sums, packed_pixels):
    """Counts of each order's own segment, beside ``px``; orders without one go."""
    joined = attach(sums, packed_pixels, ["cal_id", "ord"], row_bytes=ARRAY_BYTES)
    return joined.withColumn("counts", F.transform("px", lambda p: F.get("counts", p["x"].cast("int"))))


def calibrate(spectra, shots, units=("wm",)):
    """``spectra`` with an array for each of ``units`` beside the counts."""
    rows = attach(spectra, shots.select("shot", "exposure_s"), ["shot"])
    for u in units:
        rows = rows.withColumn(u, F.zip_with("counts", "px", lambda c, p: c * p[f"f_{u}"] / F.col("exposure_s")))  # noqa: B023
    return rows.drop("exposure_s")


def unpacked(spectra, columns, pixel=("x",)):
    """One row per pixel that is not missing: keys, ``pixel`` fields of ``px``, and the array ``columns``."""
    keys = ["shot", "frame", "ord"]
    rows = spectra.select(*keys, F.explode(F.arrays_zip("px", *columns)).alias("p"))
    rows = rows.select(*keys, *[F.col(f"p.px.{c}").alias(c) for c in pixel], *[F.col(f"p.{c}").alias(c) for c in columns])
    return rows.where(F.col(columns[0]).isNotNull())


def _sum(values, of=lambda v: v):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def quiet_frames(spectra, k=5.0):
    """Frames without a point above mean + k population standard deviations; as ``background.quiet_frames``.

    Squares are taken about the middle of an order's counts and moved to the frame's mean.
    """
    some = F.filter("counts", lambda c: c.isNotNull())
    parts = spectra.select("shot", "frame", some.alias("c")).where(F.size("c") > 0).select(
        "shot", "frame", F.array_max("c").alias("top"), F.size("c").alias("n"), (_sum(F.col("c")) / F.size("c")).alias("m"), "c")
    parts = parts.withColumn("q", F.aggregate("c", F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m"))))
    # the frame's squares are those within its orders and those of the orders' means
    orders = F.collect_list(F.struct("n", "m", "q"))
    whole = parts.groupBy("shot", "frame").agg(F.max("top").alias("top"), F.sum("n").alias("n"),
                                               F.sum(F.col("n") * F.col("m")).alias("s"), orders.alias("orders"))
    mean = F.col("s") / F.col("n")
    squares = F.aggregate("orders", F.lit(0.0), lambda s, o: s + o["q"] + o["n"] * (o["m"] - mean) * (o["m"] - mean))
    return whole.select("shot", "frame", "top", mean.alias("mean"), F.sqrt(squares / F.col("n")).alias("sd")).withColumn(
        "quiet", F.col("top") <= F.col("mean") + F.lit(float(k)) * F.col("sd"))


def background_level(spectra, runs):
    """Mean counts of each order over the background run: ``(shot, ord, level)``; ``runs`` is saved.

    Frames are added up where they are read, so one value a column and task moves.
    """
    inside = attach(spectra.select("shot", "frame", "ord", "counts"), runs, ["shot"]).where(
        F.col("frame").between(F.col("run_first"), F.col("run_last")))
    means = inside.select("shot", "ord", F.posexplode("counts").alias("i", "c")).groupBy("shot", "ord", "i").agg(F.avg("c").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "c")))
    return means.groupBy("shot", "ord").agg(F.transform(ordered, lambda p: p["c"]).alias("level"))


def subtract_level(spectra, level, shots):
    """Counts less the background, as ``background.subtract_background``; ``level`` and ``shots`` are saved.

    Single-frame shots stay as they are; without a background counts are NULL and
    ``background`` is false.
    """
    rows = attach(spectra, shots.select("shot", "n_frames"), ["shot"])
    rows = attach(rows, level, ["shot", "ord"], "left", row_bytes=ARRAY_BYTES)
    single = F.col("n_frames") <= 1
    none = F.transform("counts", lambda c: F.lit(None).cast("double"))
    net = F.when(single, F.col("counts")).when(F.col("level").isNotNull(), F.zip_with("counts", "level", lambda c, b: c - b)).otherwise(none)
    return rows.withColumn("counts", net).withColumn("background", single | F.col("level").isNotNull()).drop("level", "n_frames")


def band_segments(packed_pixels, bands, pad=0.1):
    """Which of an order's columns each band takes: ``(cal_id, ord, segments)``.

    A segment is the stretch from a band's first to its last column. Bands are compared
    with the ends of an order, few rows each.
    """
    ends = packed_pixels.select("cal_id", "ord", F.transform("px", lambda p: p["wl"]).alias("wl"))
    ends = ends.withColumns({"low": F.array_min("wl"), "high": F.array_max("wl")})
    meets = (F.col("lo") - pad <= F.col("high")) & (F.col("hi") + pad >= F.col("low"))
    bands = bands.select("band", (F.col("lo") - pad).alias("from"), "lo", "hi", (F.col("hi") + pad).alias("to"))
    met = ends.join(bands, (F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low")))
    flags = F.transform("wl", lambda w: w.between(F.col("from"), F.col("to")))
    first, behind = F.array_position(flags, True), F.array_position(F.reverse(flags), True)
    met = met.withColumn("first", first.cast("int")).where("first > 0").withColumn("n", (F.size("wl") - behind - F.col("first") + 2).cast("int"))
    return met.groupBy("cal_id", "ord").agg(F.collect_list(F.struct("band", "from", "lo", "hi", "to", "first", "n")).alias("segments"))


def band_slices(spectra, segments, value="wm"):
    """``(shot, frame, band, points)``: the points ``(wl, seq, y, core)`` of each band by wavelength.

    ``core`` marks the band's own bounds; the rest of the points lies in its pad.
    """
    cut = attach(spectra.select("shot", "frame", "cal_id", "ord", F.arrays_zip("px", value).alias("p")),
                 segments, ["cal_id", "ord"], row_bytes=2048)
    cut = cut.select("shot", "frame", "p", F.explode("segments").alias("s"))
    points = F.transform(F.slice("p", F.col("s.first"), F.col("s.n")), lambda p: F.struct(
        p["px"]["wl"].alias("wl"), p["px"]["seq"].alias("seq"), p[value].alias("y"),
        ((p["px"]["wl"] >= F.col("s.lo")) & (p["px"]["wl"] <= F.col("s.hi"))).alias("core")))
    points = F.filter(points, lambda p: p["wl"].between(F.col("s.from"), F.col("s.to")))
    # a band over the border of two orders has points of both
    return cut.select("shot", "frame", F.col("s.band").alias("band"), points.alias("points")).groupBy("shot", "frame", "band").agg(
        F.array_sort(F.flatten(F.collect_list("points"))).alias("points"))


def subtract_line(slices):
    """Core points after the line through the slice's two ends; as ``bands.subtract_line``."""
    n = F.size("points")
    d = F.greatest(F.lit(5), F.floor(n * 0.01)).cast("int")
    rows = slices.where(n > 0).withColumns({
        "head": F.slice("points", F.lit(1), d), "tail": F.slice("points", F.greatest(n - d, F.lit(0)) + 1, d)})

    def mean(of, field):
        some = F.filter(F.transform(of, lambda p: p[field]), lambda v: v.isNotNull())
        return F.when(F.size(some) > 0, _sum(some) / F.size(some))

    ends = F.struct(mean("head", "y").alias("c1"), mean("tail", "y").alias("c2"), mean("head", "wl").alias("d1"), mean("tail", "wl").alias("d2"))
    rows = rows.select("shot", "frame", "band", "points", ends.alias("e"), F.col("points")[0]["wl"].alias("start"))
    rows = rows.withColumn("rise", (F.col("e.c2") - F.col("e.c1")) / F.nullif(F.col("e.d2") - F.col("e.d1"), F.lit(0.0)))
    level = F.col("e.c1") - F.col("rise") * F.col("start")
    core = F.transform(F.filter("points", lambda p: p["core"]), lambda p: F.struct(
        p["wl"].alias("wl"), p["seq"].alias("seq"), (p["y"] - (F.col("rise") * p["wl"] + level)).alias("y")))
    return rows.select("shot", "frame", "band", core.alias("points")).where(F.size("points") > 0)


def integrate(slices):
    """Trapezoid integral of each slice; NULL where a point is missing, 0 for a single one."""
    n = F.size("points")
    steps = F.zip_with(F.slice("points", F.lit(2), n), F.slice("points", F.lit(1), n - 1),
                       lambda b, a: (b["y"] + a["y"]) / 2 * (b["wl"] - a["wl"]))
    lost = F.exists("points", lambda p: p["y"].isNull())
    return slices.select("shot", "frame", "band", F.when(~lost, _sum(steps)).alias("intensity"))


def points_of(slices):
    """Rows ``(shot, frame, band, wl, seq, y)`` of packed points, for the fits."""
    return slices.select("shot", "frame", "band", F.explode("points").alias("p")).select("shot", "frame", "band", "p.wl", "p.seq", "p.y")
