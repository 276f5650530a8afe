"""Spectra and line intensities of many shots as one plan each.

Spectra are packed (``operators.packed``): one row per order of a frame, so pixels are
never joined or shuffled one by one.
"""

from pyspark.sql import functions as F

from spectralake.operators import background, bands, packed
from spectralake.sources.bucketed import save_store
from spectralake.storage import attach, save


def stitched(frame_rows, calibration):
    """Stitched counts of every frame, with the calibration of each pixel.

    ``frame_rows`` is ``(shot, frame, y, row, cal_id)``. The two calibration
    tables come to the images; the only exchange carries packed order sums.
    """
    return packed.stitch(packed.frame_sums(frame_rows, calibration.row_runs), calibration.orders)


def calibrated_spectra(frame_rows, calibration, shots, k=5.0, units=("wm",)):
    """Background-free spectra in ``units``; ``shots`` is saved, one row per shot.

    The stitched counts are a store by shot and frame: the background run and the
    subtraction both read it, images must not be cut twice, and neither quiet frames nor
    band slices need an exchange of it.
    """
    counts = save_store(stitched(frame_rows, calibration).drop("px"), order=("ord",))
    runs = save(background.longest_run(packed.quiet_frames(counts, k)))
    level = save(packed.background_level(counts, runs))
    net = packed.subtract_level(counts, level, shots)
    net = attach(net, calibration.orders, ["cal_id", "ord"], row_bytes=packed.ARRAY_BYTES)
    return packed.calibrate(net, shots, units), runs


def band_points(spectra, calibration, band_table, pad=0.1, value="wm"):
    """Core points of every band after the endpoint-line baseline, packed by slice."""
    segments = save(packed.band_segments(calibration.orders, band_table, pad))
    return packed.subtract_line(packed.band_slices(spectra, segments, value))


def intensities(spectra, calibration, band_table, shots, lines=None, fitted=(), pad=0.1, value="wm"):
    """Intensity of every band in every frame; single-frame shots have none.

    Bands named in ``fitted`` take the fitted intensity in frames from 1 on where a
    line stands out of the noise.
    """
    many = shots.where("n_frames > 1").select("shot")
    points = band_points(spectra.join(many, "shot", "left_semi"), calibration, band_table, pad, value)
    if not fitted:
        return packed.integrate(points)
    points = save(points)
    whole = packed.integrate(points)
    chosen = save(packed.points_of(points.where(F.col("band").isin(*fitted) & (F.col("frame") >= 1))))
    strong = bands.detect(chosen).where("signal").select(*bands.SLICE)
    clear = save(chosen.join(strong, list(bands.SLICE), "left_semi"))
    ratios = bands.line_ratios(lines)
    fits = save(bands.fit_bands(clear, ratios))
    fit_area = bands.integrate_fit(bands.fit_samples(fits, ratios, clear))
    kept = whole.where(~F.col("band").isin(*fitted) | (F.col("frame") >= 1))
    return bands.combine(kept, fit_area)


def intensity_table(values, shots, band_order):
    """Time by band table, as written to files."""
    return bands.intensity_table(bands.with_time(values, shots), band_order)
