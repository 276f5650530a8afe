"""Absolute calibration and spectral units."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralake.functions import solver
from spectralake.storage import attach

# 2019 SI constants, m/s and J s, and mW/(cm2 sr um) to W/(m2 sr nm).
LIGHT_SPEED = 299792458.0
PLANCK = 6.62607015e-34
TO_SI = 1e-2

# Unit labels as written to files and shown on screen.
UNITS = {
    "counts": "counts",
    "wm": "W/(m2 nm)",
    "wmsr": "W/(m2 sr nm)",
    "phmsr": "Nph./(m2 sr)",
}

PIXEL = ("cal_id", "ord", "x")
CELL_NM = 8.0       # wavelengths and knot intervals meet in cells of this width


def _segments(knots):
    line = W.partitionBy("cal_id").orderBy("nm")
    return (
        knots.select("cal_id", (F.col("um") * 1000).alias("nm"), "mw")
        .withColumn("nm1", F.lead("nm").over(line)).withColumn("mw1", F.lead("mw").over(line))
        .withColumn("first", F.lag("nm").over(line).isNull()).where("nm1 is not null")
    )


def _in_segment(points, segments, value, strict):
    """Value at each wavelength from the one knot interval that holds it, upper end included.

    An interval is unfolded to the cells it touches, so a pixel meets the one or two
    intervals of its own cell and not all of the lamp. Wavelengths no interval holds are
    NULL, or stop the job when ``strict``.
    """
    cell = lambda c: F.floor(c / F.lit(CELL_NM))
    p = points.select(*PIXEL, "wl", cell(F.col("wl")).alias("cell")).alias("p")
    k = segments.withColumn("cell", F.explode(F.sequence(cell(F.col("nm")), cell(F.col("nm1"))))).alias("k")
    nm, wl = F.col("nm"), F.col("wl")
    inside = ((wl > nm) & (wl <= F.col("nm1"))) | (F.col("first") & (wl == nm))
    outside = F.raise_error(F.lit("wavelength outside the lamp's irradiance table")).cast("double")
    same = (F.col("p.cal_id") == F.col("k.cal_id")) & (F.col("p.cell") == F.col("k.cell"))
    # knots are unfolded from few bytes, so Spark would take them for a small table
    return p.join(k.hint("merge"), same & inside, "left").select(
        *[F.col(f"p.{c}") for c in PIXEL], "wl",
        F.when(nm.isNotNull(), value).otherwise(outside if strict else F.lit(None)).alias("irradiance"))


def irradiance_linear(points, knots, strict=False):
    """Lamp irradiance at each wavelength, linear between knots."""
    w = (F.col("wl") - F.col("nm")) / (F.col("nm1") - F.col("nm"))
    return _in_segment(points, _segments(knots), F.col("mw") + w * (F.col("mw1") - F.col("mw")), strict)


def spline_segments(knots):
    """Not-a-knot cubic spline of each lamp as one row per knot interval.

    A lamp is one group: its knots are sorted and swept once. Below four knots there is
    no such spline, so the bends are NULL.
    """
    import numpy as np
    import pandas as pd

    schema = ("cal_id long, nm double, nm1 double, mw double, mw1 double, "
              "bend double, bend1 double, first boolean")

    def solve(pdf):
        pdf = pdf.sort_values("nm")
        x, y = pdf["nm"].to_numpy(float), pdf["mw"].to_numpy(float)
        m = solver.spline_second_derivatives(x, y) if len(x) > 3 else np.full(len(x), np.nan)
        return pd.DataFrame({
            "cal_id": pdf["cal_id"].to_numpy()[:-1], "nm": x[:-1], "nm1": x[1:], "mw": y[:-1],
            "mw1": y[1:], "bend": m[:-1], "bend1": m[1:], "first": np.arange(len(x) - 1) == 0})

    source = knots.select(F.col("cal_id").cast("long").alias("cal_id"),
                          (F.col("um") * 1000).alias("nm"), F.col("mw").cast("double").alias("mw"))
    return source.groupBy("cal_id").applyInPandas(solve, schema)


def irradiance_cubic(points, knots, strict=False):
    """Lamp irradiance at each wavelength by cubic spline."""
    h = F.col("nm1") - F.col("nm")
    a, b = (F.col("nm1") - F.col("wl")) / h, (F.col("wl") - F.col("nm")) / h
    bent = ((a * a * a - a) * F.col("bend") + (b * b * b - b) * F.col("bend1")) * h * h / 6
    return _in_segment(points, spline_segments(knots), a * F.col("mw") + b * F.col("mw1") + bent, strict)


def sphere_net(sphere, dark):
    """Net sphere counts on the stitched pixels; both ``(cal_id, ord, x, counts)`` of frame 0."""
    d = dark.select(*PIXEL, F.col("counts").alias("dark"))
    return sphere.join(d, list(PIXEL)).select(*PIXEL, (F.col("counts") - F.col("dark")).alias("net"))


def absolute_factors(net, irradiance, exposures):
    """Factors from counts per second to each unit; ``exposures`` is the sphere's, per set."""
    import math

    wmsr = F.col("irradiance") * F.col("exposure_s") / F.when(F.col("net") != 0, F.col("net")) * TO_SI
    return (
        net.join(irradiance, list(PIXEL)).join(exposures.select("cal_id", "exposure_s"), "cal_id")
        .withColumn("f_wmsr", wmsr)
        .select(*PIXEL, "wl", (F.col("f_wmsr") * (4 * math.pi)).alias("f_wm"), "f_wmsr",
                (F.col("f_wmsr") * F.col("wl") * 1e-9 / (LIGHT_SPEED * PLANCK)).alias("f_phmsr"))
    )


def calibrate(spectra, shots):
    """Counts to the three units. ``spectra`` carries the factors of its pixels."""
    return (
        attach(spectra, shots.select("shot", "exposure_s"), ["shot"])
        .select(*[c for c in spectra.columns if not c.startswith("f_")],
                *[(F.col("counts") * F.col(f"f_{u}") / F.col("exposure_s")).alias(u)
                  for u in ("wm", "wmsr", "phmsr")])
    )


def select_unit(spectra, unit):
    """Spectrum in one unit, as ``value``, with its label."""
    others = [c for c in spectra.columns if c not in UNITS]
    return spectra.select(*others, F.lit(unit).alias("unit"), F.lit(UNITS[unit]).alias("label"),
                          F.col(unit).cast("double").alias("value"))


def unpivot_units(spectra):
    """One row per unit."""
    others = [c for c in spectra.columns if c not in UNITS]
    labels = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    return (
        spectra.withColumn("counts", F.col("counts").cast("double"))
        .unpivot(others, list(UNITS), "unit", "value").withColumn("label", labels[F.col("unit")])
    )


def subtract_spectrum(spectra, other, value="wm", keys=("shot", "frame", "ord", "x")):
    """Subtract the spectrum of a separate background file, in calibrated units.

    Points the file does not have stay, as NULL.
    """
    o = other.select(*keys, F.col(value).alias("other"))
    return spectra.join(o, list(keys), "left").withColumn(value, F.col(value) - F.col("other")).drop("other")
