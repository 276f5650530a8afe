"""Wavelength calibration, order crossings and stitching.

Every table is keyed by ``cal_id`` and the order number; missing is NULL.

Pixel tables meet by shuffle, and that is asked for: Spark goes by the size of files, and
those of saved sums or of what was unfolded may be a hundredth of their rows in memory.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralake.functions import batched, polyfit
from spectralake.storage import save

ORDER = ("cal_id", "ord")


def fit_dispersion(line_list, origin=0.0):
    """Pixel to wavelength per order: a line below three calibration lines, else a parabola."""
    return polyfit.fit_polynomial(line_list, list(ORDER), "px", "wl", origin=origin)


def wavelength_map(fits, width, origin=0.0):
    """Wavelength of every column of every order."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    return fits.withColumn("x", every).select(
        *ORDER, "x", polyfit.evaluate(F.col("x").cast("double"), origin=origin).alias("wl"))


def blank_short(wavelengths, short):
    """NULL wavelengths beyond the end of short orders."""
    return wavelengths.join(short.select(*ORDER, "x_missing").hint("merge"), list(ORDER), "left").select(
        *ORDER, "x", F.when(F.col("x_missing").isNull() | (F.col("x") < F.col("x_missing")),
                            F.col("wl")).alias("wl"))


def direction(wavelengths):
    """Sign of the wavelength change along the lowest order that has wavelengths.

    One row per set of ``wavelengths``; NULL where it has none.
    """
    ends = wavelengths.groupBy(*ORDER).agg(
        F.min(F.when(F.col("wl").isNotNull(), F.struct("x", "wl"))).alias("first"),
        F.max(F.when(F.col("wl").isNotNull(), F.struct("x", "wl"))).alias("last"))
    lowest = ends.groupBy("cal_id").agg(
        F.min(F.when(F.col("first").isNotNull(), F.struct("ord", "first", "last"))).alias("e"))
    return lowest.select("cal_id", F.signum(F.col("e.last.wl") - F.col("e.first.wl")).alias("direction"))


def flat_field(lamp, sphere):
    """Lamp order spectrum above its minimum, over the sphere's; both ``(cal_id, ord, x, counts)``."""
    lamp = lamp.withColumn("low", F.min("counts").over(W.partitionBy(*ORDER)))
    s = sphere.select(*ORDER, "x", F.col("counts").alias("sphere"))
    return lamp.join(s.hint("merge"), [*ORDER, "x"]).select(
        *ORDER, "x",
        ((F.col("counts") - F.col("low")) / F.when(F.col("sphere") != 0, F.col("sphere"))).alias("flat"))


def line_windows(spectra, lines, half):
    """Points of each expected line: ``[px0 - half, px0 + half)`` above the window's minimum.

    Lines are unfolded to the columns they cover, so the range join is an equi-join.
    """
    covered = F.explode(F.sequence(F.col("px0") - half, F.col("px0") + half - 1))
    wanted = lines.select(*ORDER, "px0", covered.alias("x"))
    window = W.partitionBy(*ORDER, "px0")
    return (
        spectra.join(wanted.hint("merge"), [*ORDER, "x"])
        .withColumn("level", F.col("flat") - F.min("flat").over(window))
        .select(*ORDER, "px0", "x", "level")
    )


def line_center_seed(windows):
    """Centre by a parabola through the logarithm of the three points at the top."""
    line = W.partitionBy(*ORDER, "px0").orderBy("x")
    near = (
        windows.withColumn("l", F.lag("level").over(line)).withColumn("r", F.lead("level").over(line))
        .where("level > 0 and l > 0 and r > 0")
    )
    top = near.groupBy(*ORDER, "px0").agg(
        F.max(F.struct("level", (-F.col("x")).alias("nx"), "l", "r")).alias("t"))
    a, b, c = F.log(F.col("t.l")), F.log(F.col("t.level")), F.log(F.col("t.r"))
    bend = a - 2 * b + c
    return top.select(*ORDER, "px0", (
        -F.col("t.nx") + F.when(bend < 0, (a - c) / 2 / bend).otherwise(0.0)).alias("centre"))


def fit_line_centers(windows):
    """Gaussian centre, width and area of each line window, many windows at once.

    One row per window: with too few points, or none above zero, the values and
    ``converged`` are NULL.
    """
    import numpy as np

    def fit(points, batch, rows):
        x, y = points.padded("x", rows)[0], points.padded("level", rows)[0]
        here = np.isfinite(y)
        able = (here.sum(1) >= 4) & (np.max(np.where(here, y, 0.0), axis=1, initial=0.0) > 0)
        first, last = (of(np.where(here, x, bad), axis=1, initial=bad) for of, bad in ((np.min, np.inf), (np.max, -np.inf)))
        first, last = np.where(able, first, 0.0), np.where(able, last, 1.0)
        wide, x, level = last - first, np.nan_to_num(x), np.where(here, y, -np.inf)
        peak = np.take_along_axis(x, level.argmax(1)[:, None], axis=1)[:, 0] if x.shape[1] else first

        def model(p, k):
            return batched.gaussians(x[k], p[..., :1], p[..., 1:2], p[..., 2:3])

        start = np.column_stack([np.where(here, y, 0.0).sum(1), peak, np.maximum(wide / 8, 0.5)])
        low, high = np.column_stack([0 * wide, first - wide, 0 * wide + 0.05]), np.column_stack([0 * wide + np.inf, last + wide, 4 * wide])
        p, _, settled = batched.least_squares(model, y, here & able[:, None], start, low, high)
        p[~able] = np.nan
        return p[:, 1], p[:, 2], p[:, 0], settled

    return batched.solved(batched.pack(windows, [*ORDER, "px0"], ["x", "level"]), fit, ["centre", "sigma", "area"]).drop("points")


def residuals(line_list, fits, origin=0.0):
    """Worst and root-mean-square distance of the lines from their order's curve.

    The line side is aggregated after the join; coefficients are one row an order.
    """
    miss = F.col("wl") - polyfit.evaluate(F.col("px").cast("double"), origin=origin)
    return (
        line_list.join(fits.drop("n"), list(ORDER)).withColumn("miss", miss)
        .groupBy(*ORDER).agg(F.count("*").alias("n"), F.max(F.abs("miss")).alias("worst"),
                             F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("rms"))
    )


def _sphere_points(wavelengths, sphere):
    """Saved sphere counts by wavelength; neighbouring orders are found from them and then read them."""
    s = sphere.select(*ORDER, "x", F.col("counts").cast("double").alias("s"))
    return save(wavelengths.select(*ORDER, "x", "wl").join(s.hint("merge"), [*ORDER, "x"]).where("wl is not null and s is not null"))


def order_crossings(wavelengths, sphere):
    """Where the sphere spectra of neighbouring orders come closest.

    An equally spaced grid covers the overlap; both orders are interpolated on it
    linearly. Grid points and order points are sorted together by wavelength, so
    the points around a grid point are the nearest order points before and after
    it: no range join. One shuffle by pair of orders serves every step. A pair
    without overlap has NULL.

    Returns ``(cal_id, ord, next_ord, cross)`` for each order and the next one present.
    """
    points = _sphere_points(wavelengths, sphere)
    orders = W.partitionBy("cal_id").orderBy("ord")
    ends = points.groupBy(*ORDER).agg(
        F.count("*").alias("n"), F.min_by("wl", "x").alias("w0"), F.max_by("wl", "x").alias("w1"))
    nxt = lambda c: F.lead(c).over(orders)
    corners = F.array_sort(F.array("w0", "w1", "v0", "v1"))
    i = F.col("i").cast("double")
    grid = (
        ends.withColumn("v0", nxt("w0")).withColumn("v1", nxt("w1"))
        .withColumn("m", nxt("n")).withColumn("next_ord", nxt("ord"))
        .where("next_ord is not null and m > 1")
        .withColumn("c", corners)
        .select(*ORDER, "next_ord", F.col("c")[1].alias("lo"), F.col("c")[2].alias("hi"), "m",
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i"))
        .withColumn("g", F.when(F.col("i") == F.col("m") - 1, F.col("hi")).otherwise(
            i * ((F.col("hi") - F.col("lo")) / (F.col("m") - 1)) + F.col("lo")))
    )

    # the points of an order serve its pair as first and as second member; a set has few orders
    members = F.explode(F.array(F.struct(F.col("ord"), F.lit(0).alias("second")),
                                F.struct(F.col("before").alias("ord"), F.lit(1).alias("second"))))
    before = ends.select(*ORDER, F.lag("ord").over(orders).alias("before"))
    order_points = points.join(before.hint("merge"), list(ORDER)).select("cal_id", members.alias("m"), "wl", "s").where("m.ord is not null").select(
        "cal_id", F.col("m.ord").alias("ord"), F.col("m.second").alias("second"), "wl", "s",
        F.lit(None).cast("long").alias("next_ord"), F.lit(None).cast("long").alias("i"))
    grid_points = grid.select(
        *ORDER, "next_ord", F.explode(F.array(F.lit(0), F.lit(1))).alias("second"), F.col("g").alias("wl"),
        F.lit(None).cast("double").alias("s"), "i")
    is_order = F.col("i").isNull()
    mixed = order_points.unionByName(grid_points).repartition(*ORDER).select(
        *ORDER, "second", "next_ord", "wl", "i", is_order.alias("is_order"), F.when(is_order, F.struct("wl", "s")).alias("here"))
    # at equal wavelength the grid point comes first, so the order point is its upper end
    line = "ignore nulls over (partition by cal_id, ord, second order by wl, is_order)"
    slope = (F.col("q.s") - F.col("p.s")) / (F.col("q.wl") - F.col("p.wl"))
    value = F.when(F.col("q.wl") == F.col("wl"), F.col("q.s")).when(
        F.col("p").isNotNull() & F.col("q").isNotNull(), F.col("p.s") + slope * (F.col("wl") - F.col("p.wl")))
    of = lambda k: F.max(F.when(F.col("second") == k, F.col("v")))
    gap = F.abs(F.col("v0") - F.col("v1"))
    return (
        mixed.select("*", F.expr(f"lag(here) {line}").alias("p"), F.expr(f"lead(here) {line}").alias("q"))
        .where("not is_order").withColumn("v", value)
        .groupBy(*ORDER, "next_ord", "i", "wl").agg(of(0).alias("v0"), of(1).alias("v1"))
        .groupBy(*ORDER, "next_ord").agg(F.min(F.when(gap.isNotNull(), F.struct(gap.alias("d"), "i", "wl"))).alias("best"))
        .select(*ORDER, "next_ord", F.col("best.wl").alias("cross"))
    )


def all_crossings(wavelengths, sphere):
    """Every place where the sphere spectra of neighbouring orders cross: ``(cal_id, ord, next_ord, wl, level)``.

    Both spectra are lines between their points. Between neighbouring points of either of
    them both are straight, so they cross there once at most, where the sign of their
    difference changes; a common point is one crossing. Points of a pair of orders are
    sorted together once and each spectrum is read between its nearest points, as in
    ``order_crossings``; pairs without a crossing have no row.
    """
    points = _sphere_points(wavelengths, sphere)
    orders = W.partitionBy("cal_id").orderBy("ord")
    present = points.select(*ORDER).distinct()
    beside = present.select(*ORDER, F.lead("ord").over(orders).alias("next_ord"), F.lag("ord").over(orders).alias("before"))
    # the points of an order serve its pair with the next one and that of the order before
    none = F.lit(None).cast("double")
    members = F.explode(F.array(
        F.struct(F.col("ord"), F.col("next_ord"), F.col("s").alias("s0"), none.alias("s1")),
        F.struct(F.col("before").alias("ord"), F.col("ord").alias("next_ord"), none.alias("s0"), F.col("s").alias("s1"))))
    both = (
        points.join(beside.hint("merge"), list(ORDER)).select("cal_id", members.alias("m"), "wl")
        .select("cal_id", "m.ord", "m.next_ord", "wl", "m.s0", "m.s1").where("ord is not null and next_ord is not null")
        .groupBy(*ORDER, "next_ord", "wl").agg(F.max("s0").alias("s0"), F.max("s1").alias("s1"))
    )
    line = W.partitionBy(*ORDER, "next_ord").orderBy("wl")
    # a window from here to its end would be read anew for every point
    for k in (0, 1):
        h = F.col(f"h{k}")
        near = lambda side: F.coalesce(h, F.expr(f"{side}(h{k}) ignore nulls over (partition by cal_id, ord, next_ord order by wl)"))  # noqa: B023, E731
        both = both.withColumn(f"h{k}", F.when(F.col(f"s{k}").isNotNull(), F.struct("wl", F.col(f"s{k}").alias("s"))))
        both = both.withColumn(f"p{k}", near("lag")).withColumn(f"q{k}", near("lead"))
    for k in (0, 1):
        p, q = F.col(f"p{k}"), F.col(f"q{k}")
        between = p["s"] + (q["s"] - p["s"]) / F.nullif(q["wl"] - p["wl"], F.lit(0.0)) * (F.col("wl") - p["wl"])
        both = both.withColumn(f"v{k}", F.coalesce(f"s{k}", between))
    d, share = F.col("d"), F.col("d") / (F.col("d") - F.col("d1"))
    rows = both.where("v0 is not null and v1 is not null").withColumn("d", F.col("v0") - F.col("v1")).select(
        *ORDER, "next_ord", "wl", "v0", "d", F.lead("wl").over(line).alias("wl1"), F.lead("v0").over(line).alias("w0"), F.lead("d").over(line).alias("d1"))
    crossed = (d < 0) & (F.col("d1") > 0) | (d > 0) & (F.col("d1") < 0)
    at = lambda a, b: F.when(d == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)
    return rows.where((d == 0) | crossed).select(*ORDER, "next_ord", at("wl", "wl1").alias("wl"), at("v0", "w0").alias("level"))


def order_borders(wavelengths, crossings, directions, width):
    """First and last column of each order, both inclusive.

    Each side keeps one column past the crossing, so neighbours overlap a little;
    the first order starts at 0, the last one ends at ``width``. Without a crossing
    a side is not trimmed and ``trimmed`` is false.
    """
    x, wl, falling = F.col("x"), F.col("wl"), F.col("direction") < 0
    # a crossing ends its own order and starts the next one
    sides = F.explode(F.array(
        F.struct("ord", F.col("cross").alias("upper"), F.lit(None).cast("double").alias("lower")),
        F.struct(F.col("next_ord").alias("ord"), F.lit(None).cast("double").alias("upper"), F.col("cross").alias("lower"))))
    limits = crossings.select("cal_id", sides.alias("s")).groupBy("cal_id", F.col("s.ord").alias("ord")).agg(
        F.max("s.upper").alias("upper"), F.max("s.lower").alias("lower"))
    last = F.when(F.first("falling"), F.max(F.when(wl > F.col("upper"), x))).otherwise(
        F.min(F.when(wl > F.col("upper"), x))) + 1
    first = F.when(F.first("falling"), F.min(F.when(wl <= F.col("lower"), x))).otherwise(
        F.max(F.when(wl <= F.col("lower"), x)))
    orders = W.partitionBy("cal_id")
    return (
        wavelengths.where("wl is not null")
        .join(limits.hint("merge"), list(ORDER), "left").join(directions, "cal_id", "left").withColumn("falling", falling)
        .groupBy(*ORDER).agg(first.alias("first"), last.alias("last"))
        .withColumn("lowest", F.min("ord").over(orders)).withColumn("highest", F.max("ord").over(orders))
        .select(*ORDER,
                F.coalesce("first", F.lit(0)).cast("long").alias("x_from"),
                F.coalesce("last", F.lit(width)).cast("long").alias("x_to"),
                ((F.col("first").isNotNull() | (F.col("ord") == F.col("lowest")))
                 & (F.col("last").isNotNull() | (F.col("ord") == F.col("highest")))).alias("trimmed"))
    )


def segment_pixels(wavelengths, borders):
    """Calibrated columns that make the stitched spectrum, numbered along it.

    ``seq`` is the accumulated pixel number. It depends on the calibration only,
    so it is found once per set here and never by a window over spectra. A set has
    no more columns than its sensor has order columns.
    """
    kept = wavelengths.join(borders, list(ORDER)).where(
        (F.col("x") >= F.col("x_from")) & (F.col("x") <= F.col("x_to")) & F.col("wl").isNotNull())
    line = W.partitionBy("cal_id").orderBy("ord", "x")
    return kept.select(*ORDER, "x", "wl").withColumn("seq", F.row_number().over(line).cast("long") - 1)


def order_by_wavelength(pixels, directions):
    """Position ``pos`` by rising wavelength: ``seq`` flipped where the direction is falling.

    Done on the pixel table of a set, so spectra take it over with the pixel.
    """
    n = F.count("*").over(W.partitionBy("cal_id"))
    return pixels.withColumn("n", n).join(directions, "cal_id", "left").withColumn(
        "pos", F.when(F.col("direction") < 0, F.col("n") - 1 - F.col("seq")).otherwise(F.col("seq"))
    ).drop("n", "direction")
