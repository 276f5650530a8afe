"""Calibration of whole campaigns: from pattern, lamp lines and sphere to pixel tables."""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectralake.operators import absolute, extraction, packed, wavelength
from spectralake.storage import save


@dataclass
class Calibration:
    """Saved tables of all calibration sets.

    ``runs``: mask stretches. ``pixels``: ``(cal_id, ord, x, wl, seq, pos)``, the
    stitched pixels with their position by rising wavelength, and the unit
    factors where a sphere exposure was given; these are NULL where the lamp's table
    gives no irradiance. ``outside``: ``(cal_id, n)``, the sets that have such pixels.
    """

    runs: DataFrame
    pixels: DataFrame
    outside: DataFrame | None = None

    @cached_property
    def row_runs(self):
        """``runs`` with one row per image row, saved."""
        return save(packed.pack_runs(self.runs))

    @cached_property
    def orders(self):
        """``pixels`` with one row per order, saved."""
        return save(packed.pack_pixels(self.pixels))


def image_sums(images, runs):
    """Order sums ``(cal_id, ord, x, sphere, dark)`` of both calibration images in one pass.

    The images of a set are one single-frame shot whose pixels are pairs.
    """
    pairs = images.select(
        F.col("cal_id").alias("shot"), F.lit(0).cast("long").alias("frame"), "cal_id", "y",
        F.arrays_zip("sphere", "dark").alias("row"))
    return extraction.cut_rows(pairs, runs).groupBy("cal_id", "ord", "x").agg(
        F.sum("counts.sphere").alias("sphere"), F.sum("counts.dark").alias("dark"))


def one_image(sums, image):
    """Order spectra of one calibration image."""
    return sums.select("cal_id", "ord", "x", F.col(image).alias("counts"))


def wavelengths(pattern, line_list, dv, dim_w, dim_o):
    """Wavelength of every column of every order, NULL past the end of short orders."""
    short = extraction.short_orders(pattern, dv, dim_o, dim_w)
    fits = wavelength.fit_dispersion(line_list, origin=dim_w / 2)
    full = wavelength.wavelength_map(fits, dim_w, origin=dim_w / 2)
    return wavelength.blank_short(full, short)


def stitched_pixels(wl, sphere, dim_w):
    """Segments of the orders between their crossings, numbered along the spectrum."""
    turn = wavelength.direction(wl)
    borders = wavelength.order_borders(wl, wavelength.order_crossings(wl, sphere), turn, dim_w)
    return wavelength.order_by_wavelength(wavelength.segment_pixels(wl, borders), turn)


def calibrate(pattern, line_list, images, dv, dim_w, dim_o, knots=None, exposures=None, cubic=True, sets=None):
    """Run the chain for every set at once, or for those in ``sets`` (cal_id).

    ``images`` is ``(cal_id, y, sphere, dark)`` with one array per image row.
    Tables are saved where several later steps read them.
    """
    if sets is not None:
        pattern, line_list, images, knots, exposures = (
            t if t is None else t.join(sets, "cal_id", "left_semi") for t in (pattern, line_list, images, knots, exposures))
    runs = extraction.sensor_runs(pattern, dv, dim_o)
    sums = save(image_sums(images, runs))
    sphere = one_image(sums, "sphere")
    wl = save(wavelengths(pattern, line_list, dv, dim_w, dim_o))
    pixels = save(stitched_pixels(wl, sphere, dim_w))
    if knots is None:
        return Calibration(runs, pixels)
    interpolate = absolute.irradiance_cubic if cubic else absolute.irradiance_linear
    net = absolute.sphere_net(sphere, one_image(sums, "dark"))
    irradiance = save(interpolate(pixels, knots))
    outside = save(irradiance.where("wl is not null and irradiance is null").groupBy("cal_id").agg(F.count("*").alias("n")))
    factors = absolute.absolute_factors(net, irradiance, exposures)
    return Calibration(runs, save(pixels.join(factors.drop("wl"), ["cal_id", "ord", "x"])), outside)
