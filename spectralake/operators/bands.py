"""Emission bands: weights, slices, baselines, intensities and fits.

``SLICE`` names one band in one frame. A slice holds the few points of a band,
so windows and grouped jobs over it stay small however long a shot is.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralake.functions import batched
from spectralake.storage import attach, spread

SLICE = ("shot", "frame", "band")

# Orbital letters in order of l, the line width range in nm and its
# start, the hydrogen line ratio, and the noise limits in W/(m2 nm).
ORBITALS = "spdfghik"
FWHM = 2.355
SIGMA_RANGE = (0.03 / FWHM, 0.2 / FWHM)
SIGMA_START = 0.06 / FWHM
HYDROGEN_RATIO = (0.06, 1.0)
NOISE_OFFSET, NOISE_TOP = 0.11, 0.3


def band_bounds(lines, overrides, centres=None, dw=0.5, pad=0.3):
    """Integration bounds of each band: its override, else its centre with ``dw`` on
    each side, else the mean wavelength with ``pad`` on each side.

    Bands that exist in ``overrides`` only are integrate-only bands.
    """
    base = lines.groupBy("band").agg(F.avg("wl").alias("mean"))
    over = overrides.select("band", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    table = base.join(over, "band", "full")
    if centres is not None:
        table = table.join(centres, "band", "left")
    else:
        table = table.withColumn("centre", F.lit(None).cast("double"))
    return table.select(
        "band",
        F.coalesce("o_lo", F.col("centre") - dw, F.col("mean") - pad).alias("lo"),
        F.coalesce("o_hi", F.col("centre") + dw, F.col("mean") + pad).alias("hi"))


def _fraction(text):
    """``3``, ``1/2`` or ``1 1/2`` as a number."""
    whole = F.coalesce(F.regexp_extract(text, r"^(-?\d+) ", 1).try_cast("double"), F.lit(0.0))
    part = (F.regexp_extract(text, r"(-?\d+)/", 1).try_cast("double")
            / F.nullif(F.regexp_extract(text, r"/(\d+)", 1).try_cast("double"), F.lit(0.0)))
    return F.coalesce(F.trim(text).try_cast("double"),
                      F.when(whole < 0, whole - part).otherwise(whole + part))


def stat_weights(lines):
    """Statistical weight of each line's upper level, as ``g``.

    ``2 J + 1`` with the upper J; with ``*`` for J, ``2 (2 l + 1)`` with l from the
    last letter of the configuration.
    """
    upper = F.get(F.split("j", "-"), F.lit(1))
    orbital = F.instr(F.lit(ORBITALS), F.substring("config", -1, 1)) - 1
    return lines.withColumn(
        "g", F.when(F.contains(upper, F.lit("*")), F.when(orbital >= 0, 2.0 * (2.0 * orbital + 1)))
        .otherwise(2 * _fraction(upper) + 1))


def mean_rates(lines):
    """Weighted mean transition rate of each band."""
    return stat_weights(lines).groupBy("band").agg(
        (F.sum(F.col("ak") * F.col("g")) / F.sum("g")).alias("avg_ak"))


def band_report(lines, bounds):
    """One row per band: its lines, mean upper energy, mean rate, weight sum and bounds."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "wl"))), lambda v: v["wl"])
    return (
        stat_weights(lines).groupBy("band").agg(
            listed.alias("wls"), F.avg("e_high").alias("e_mean"),
            (F.sum(F.col("ak") * F.col("g")) / F.sum("g")).alias("avg_ak"), F.sum("g").alias("g_sum"))
        .join(bounds, "band")
        .select("band", F.array_join(F.transform("wls", lambda v: F.format_string("%.3f", v)), " ").alias("lines"),
                F.format_string("%.2f", "e_mean").alias("e_term"),
                F.format_string("%.2e", "avg_ak").alias("avg_ak"),
                F.format_string("%.0f", "g_sum").alias("g_sum"),
                F.format_string("%.2f - %.2f (nm)", "lo", "hi").alias("bounds"))
    )


def line_ratios(lines):
    """Amplitude of each line relative to line 0, ``A g``; fixed for hydrogen pairs."""
    first = W.partitionBy("band").orderBy("line")
    weight = F.col("ak") * F.col("g")
    hydrogen = F.col("band").rlike("H-(a|be|g)")
    return (
        stat_weights(lines)
        .withColumn("ratio", F.when(hydrogen & (F.col("line") == 0), HYDROGEN_RATIO[0])
                    .when(hydrogen, HYDROGEN_RATIO[1]).otherwise(weight / F.first(weight).over(first)))
        .withColumn("offset", F.col("wl") - F.first("wl").over(first))
        .withColumn("wl0", F.first("wl").over(first))
        .select("band", "line", "wl0", "offset", "ratio")
    )


def band_slices(spectra, bands, pad=0.1, value="wm", cell=None):
    """Points of each band's bounds widened by ``pad``; ``core`` marks the bounds.

    Wavelengths and bands meet in cells of ``cell`` nm: a band is unfolded to the
    cells it touches, so the range join is an equi-join on the cell and a point
    is compared with the bands of its own cell only. ``bands`` is ``(band, lo, hi)``
    and comes to the spectra while its counted size allows.
    """
    cell = float(cell or 1.0)
    bin_of = lambda c: F.floor(c / F.lit(cell))
    wide = bands.select(
        "band", "lo", "hi",
        F.explode(F.sequence(bin_of(F.col("lo") - pad), bin_of(F.col("hi") + pad))).alias("cell"))
    return (
        attach(spectra.where("wl is not null").withColumn("cell", bin_of(F.col("wl"))), wide, ["cell"])
        .where((F.col("wl") >= F.col("lo") - pad) & (F.col("wl") <= F.col("hi") + pad))
        .select("shot", "frame", "band", "wl", "seq", F.col(value).cast("double").alias("y"),
                ((F.col("wl") >= F.col("lo")) & (F.col("wl") <= F.col("hi"))).alias("core"))
    )


def subtract_line(slices):
    """Subtract the line through the two ends of the widened slice; keeps the core.

    Each end is the mean of its ``max(5, n // 100)`` points. The line starts with
    the first mean at the slice's first wavelength.
    """
    part = W.partitionBy(*SLICE)
    line = part.orderBy("wl", "seq")
    d = F.greatest(F.lit(5), F.floor(F.col("n") * 0.01))
    left, right = F.col("rn") <= F.col("d"), F.col("rn") > F.col("n") - F.col("d")
    mean = lambda inside, c: F.avg(F.when(inside, F.col(c))).over(part)
    return (
        slices.select("*", F.row_number().over(line).alias("rn"), F.count("*").over(part).alias("n"))
        .withColumn("d", d)
        .select("*", mean(left, "y").alias("c1"), mean(right, "y").alias("c2"),
                mean(left, "wl").alias("d1"), mean(right, "wl").alias("d2"),
                F.min("wl").over(part).alias("first_wl"))
        .where("core")
        .withColumn("rise", (F.col("c2") - F.col("c1")) / F.nullif(F.col("d2") - F.col("d1"), F.lit(0.0)))
        .withColumn("y", F.col("y") - (
            F.col("rise") * F.col("wl") + (F.col("c1") - F.col("rise") * F.col("first_wl"))))
        .select(*SLICE, "wl", "seq", "y")
    )


def subtract_als(slices, stiffness=1e7, weight=1e-5, rounds=5):
    """Subtract the mean of an asymmetric-least-squares baseline; keeps the core.

    Slices are swept side by side. ``baseline`` is that mean; missing points have no say
    in it. ``converged`` tells whether the curve had settled after ``rounds``.
    """
    import numpy as np

    def fit(points, batch, rows):
        y, _ = points.padded("y", rows)
        there = np.isfinite(y)
        sizes = there.sum(1)
        # present points to the front, in order
        y = np.take_along_axis(y, np.argsort(~there, axis=1, kind="stable"), axis=1)
        curve, settled = batched.smooth_below(y, sizes, stiffness, weight, rounds)
        here = np.arange(y.shape[1]) < sizes[:, None]
        return np.where(sizes > 0, np.where(here, curve, 0.0).sum(1) / np.maximum(sizes, 1), np.nan), settled

    found = batched.solved(batched.pack(slices, SLICE, ["wl", "seq", "y", "core"]), fit, ["baseline"])
    rows = found.select(*SLICE, F.explode("points").alias("p"), "baseline", "converged").where("p.core")
    return rows.select(*SLICE, "p.wl", "p.seq", (F.col("p.y") - F.col("baseline")).alias("y"), "baseline", "converged")


def integrate(slices):
    """Trapezoid integral of each slice; NULL where a point is missing, 0 for a single one."""
    line = W.partitionBy(*SLICE).orderBy("wl", "seq")
    step = (F.col("y") + F.lag("y").over(line)) / 2 * (F.col("wl") - F.lag("wl").over(line))
    return slices.withColumn("step", step).groupBy(*SLICE).agg(
        F.when(F.count("y") == F.count("*"), F.coalesce(F.sum("step"), F.lit(0.0))).alias("intensity"))


def detect(slices, offset=NOISE_OFFSET, top=NOISE_TOP):
    """Whether a slice stands out of the noise enough to be fitted."""
    stats = slices.groupBy(*SLICE).agg(
        F.max("y").alias("top"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    return stats.withColumn("signal", ~(
        (F.col("top") < F.col("sd") + F.col("mean") + offset) & (F.col("top") < top)))


def _best_node(points, ratios, steps):
    """Best node of a grid of centres and widths, per slice.

    The amplitude has a closed form on every node, so a node needs two sums. The
    points are partitioned by slice before nodes are unfolded: the sums and the
    choice then stay in their task, and only points are shuffled.
    """
    lines = F.col("lines")
    shape = F.aggregate(lines, F.lit(0.0), lambda s, l: s + l["ratio"] * F.exp(
        -(F.col("wl") - F.col("centre") - l["offset"]) * (F.col("wl") - F.col("centre") - l["offset"])
        / (2 * F.col("sigma") * F.col("sigma")))) / (F.sqrt(F.lit(2 * 3.141592653589793)) * F.col("sigma"))
    nodes = F.explode(F.sequence(F.lit(0), F.lit(steps * steps - 1)))
    delta = F.col("ym") / F.col("mm")
    return (
        attach(points, ratios, ["band"]).repartition(*SLICE)
        .withColumn("node", nodes)
        .withColumn("centre", F.col("c_lo") + (F.col("c_hi") - F.col("c_lo")) * F.floor(F.col("node") / steps) / (steps - 1))
        .withColumn("sigma", F.col("s_lo") + (F.col("s_hi") - F.col("s_lo")) * (F.col("node") % steps) / (steps - 1))
        .withColumn("m", shape)
        .groupBy(*SLICE, "node", "centre", "sigma")
        .agg(F.sum(F.col("y") * F.col("m")).alias("ym"), F.sum(F.col("m") * F.col("m")).alias("mm"))
        .withColumn("delta", F.when((F.col("mm") > 0) & (F.col("ym") > 0), delta).otherwise(0.0))
        .withColumn("gain", F.col("delta") * F.col("ym"))
        .groupBy(*SLICE)
        .agg(F.min(F.struct((-F.col("gain")).alias("loss"), "node", "centre", "sigma", "delta")).alias("b"))
        .select(*SLICE, F.col("b.centre").alias("centre"), F.col("b.sigma").alias("sigma"),
                F.col("b.delta").alias("delta"))
    )


def pack_ratios(ratios):
    """Lines of each band as one array row; a band has a handful of lines."""
    return ratios.groupBy("band").agg(
        F.first("wl0").alias("wl0"),
        F.array_sort(F.collect_list(F.struct("line", "offset", "ratio"))).alias("lines"))


def fit_bands_grid(slices, ratios, reach=0.1, sigma=SIGMA_RANGE, steps=21):
    """Tied Gaussians by grid search, twice: over ``wl0 +- reach`` and the width range,
    then around the best node. All in built-in expressions.
    """
    packed = pack_ratios(ratios)
    s_lo, s_hi = sigma
    wide = (
        attach(slices, packed.select("band", "wl0"), ["band"])
        .withColumn("c_lo", F.col("wl0") - reach).withColumn("c_hi", F.col("wl0") + reach)
        .withColumn("s_lo", F.lit(float(s_lo))).withColumn("s_hi", F.lit(float(s_hi))).drop("wl0")
    )
    lines = packed.select("band", "lines")
    first = _best_node(wide, lines, steps)
    c_step, s_step = 2 * reach / (steps - 1), (s_hi - s_lo) / (steps - 1)
    near = first.select(
        *SLICE, (F.col("centre") - c_step).alias("c_lo"), (F.col("centre") + c_step).alias("c_hi"),
        F.greatest(F.lit(float(s_lo)), F.col("sigma") - s_step).alias("s_lo"),
        F.least(F.lit(float(s_hi)), F.col("sigma") + s_step).alias("s_hi"))
    return _best_node(slices.join(near, list(SLICE)), lines, steps)


def fit_bands(slices, ratios, sigma=SIGMA_RANGE, sigma_start=SIGMA_START):
    """Tied Gaussians by bounded least squares, many slices at once.

    Three parameters: centre of line 0, common width in ``sigma``, amplitude >= 0. One row
    per slice: with fewer than three points, or none above zero, all are NULL. Missing
    points are left out.
    """
    import numpy as np

    def fit(points, batch, rows):
        x, y = points.padded("wl", rows)[0], points.padded("y", rows)[0]
        lines = batched.Lists(batch.column(batch.schema.get_field_index("lines")))
        offset, ratio = (np.nan_to_num(lines.padded(f, rows)[0]) for f in ("offset", "ratio"))
        wl0 = batch.column(batch.schema.get_field_index("wl0")).to_numpy(zero_copy_only=False)[rows]
        here = np.isfinite(y)
        top = np.max(np.where(here, y, 0.0), axis=1, initial=0.0)
        able = (here.sum(1) >= 3) & (top > 0)
        x, y = np.nan_to_num(x), np.where(here, y, 0.0) / np.where(able, top, 1.0)[:, None]

        def model(p, k):
            return batched.gaussians(x[k], p[..., 2:] * ratio[k][:, None], p[..., :1] + offset[k][:, None], np.repeat(p[..., 1:2], ratio.shape[1], axis=2))

        start = np.column_stack([wl0, np.full(len(rows), sigma_start), np.ones(len(rows))])
        # the amplitude is linear: start from its best value at the starting shape
        m = model(start[:, None], np.arange(len(rows)))[:, 0] * here
        start[:, 2] = np.maximum((m * y).sum(1) / np.maximum((m * m).sum(1), 1e-300), 1e-6)
        p, _, settled = batched.least_squares(model, y, here & able[:, None], start, [-np.inf, sigma[0], 0.0], [np.inf, sigma[1], np.inf])
        p[~able] = np.nan
        return p[:, 0], p[:, 1], p[:, 2] * top, settled

    packed = attach(batched.pack(spread(slices, *SLICE), SLICE, ["wl", "y"]), pack_ratios(ratios), ["band"])
    return batched.solved(packed, fit, ["centre", "sigma", "delta"]).select(*SLICE, "centre", "sigma", "delta", "converged")


def fit_samples(fits, ratios, slices, factor=10):
    """Fitted components on a grid ``factor`` times finer than the slice."""
    span = slices.groupBy(*SLICE).agg(
        F.min("wl").alias("lo"), F.max("wl").alias("hi"), (F.count("*") * factor).alias("points"))
    i = F.col("i").cast("double")
    x = F.when(F.col("i") == F.col("points") - 1, F.col("hi")).otherwise(
        i * ((F.col("hi") - F.col("lo")) / (F.col("points") - 1)) + F.col("lo"))
    z = (F.col("x") - F.col("centre") - F.col("offset")) / F.col("sigma")
    return (
        attach(fits.join(span, list(SLICE)), ratios.drop("wl0"), ["band"])
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("points") - 1)))
        .withColumn("x", x)
        .select(*SLICE, "line", "i", "x", (
            F.col("delta") * F.col("ratio") / (F.sqrt(F.lit(2 * 3.141592653589793)) * F.col("sigma"))
            * F.exp(-z * z / 2)).alias("y"))
    )


def integrate_fit(samples):
    """Trapezoid integral of the summed components."""
    total = samples.groupBy(*SLICE, "i", "x").agg(F.sum("y").alias("y"))
    return integrate(total.select(*SLICE, F.col("x").alias("wl"), F.col("i").alias("seq"), "y"))


def combine(integrated, fitted):
    """Fitted intensity where a fit is present, else the integrated one."""
    fit = fitted.select(*SLICE, F.col("intensity").alias("fit"))
    return integrated.join(fit, list(SLICE), "left").select(
        *SLICE, F.coalesce("fit", "intensity").alias("intensity"))


def select_frames(intensities, shots, first=1):
    """Intensities of frames from ``first`` on; the other frames of the shot are NULL.

    ``shots`` is ``(shot, n_frames)``, saved. Every frame of every band is present.
    """
    bands = intensities.select("shot", "band").distinct()
    frames = attach(bands, shots.select("shot", "n_frames"), ["shot"]).select(
        "shot", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    return frames.join(intensities.where(F.col("frame") >= first), list(SLICE), "left").select(
        *SLICE, "intensity")


def with_time(df, shots):
    """Time of each frame: trigger delay plus frame number times cycle time.

    ``shots`` is saved, one row per shot.
    """
    return attach(df, shots.select("shot", "trig_delay_s", "cycle_s"), ["shot"]).withColumn(
        "time_s", F.col("trig_delay_s") + F.col("frame") * F.col("cycle_s")).drop("trig_delay_s", "cycle_s")


def intensity_table(timed, bands, first=1):
    """Time by band table without frame 0; ``bands`` fixes the columns and their order."""
    return timed.where(F.col("frame") >= first).groupBy("shot", "frame", "time_s").pivot(
        "band", list(bands)).agg(F.first("intensity"))


def trace(intensities, band):
    """Non-missing points of one band."""
    return intensities.where((F.col("band") == band) & F.col("intensity").isNotNull()).select(
        "shot", "frame", "intensity")
