"""Cutting diffraction orders out of images and summing them.

The mask of a calibration set is held as runs: one image row meets one order in
a few contiguous stretches of columns, because row centres are whole numbers.
Frames therefore join on the row number only and are cut with array slices;
pixels outside every order are never turned into rows.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralake.storage import attach, save, spread


def make_mask(pattern, dv):
    """Mask pixels ``(cal_id, ord, x, y)``: rows ``yc - dv .. yc + dv``."""
    rows = F.sequence(F.col("yc") - dv, F.col("yc") + dv)
    return pattern.where(F.col("yc").isNotNull()).select(
        "cal_id", "ord", "x", F.explode(rows).alias("y"))


def truncated_pattern(pattern, dv, dim_o):
    """Pattern cut where an order leaves the sensor.

    From the first column whose rows pass the top on, the rest of the order is
    dropped, even where it returns. The test needs only the row centre, so it
    runs before the mask is unfolded.
    """
    first_off = pattern.where(F.col("yc") + dv > dim_o - 1).groupBy("cal_id", "ord").agg(
        F.min("x").alias("off"))
    return (
        pattern.join(first_off.hint("merge"), ["cal_id", "ord"], "left")
        .where(F.col("off").isNull() | (F.col("x") < F.col("off"))).drop("off")
    )


def truncate_mask(pattern, dv, dim_o):
    """Mask of the orders as far as they stay on the sensor; rows below 0 are dropped."""
    return make_mask(truncated_pattern(pattern, dv, dim_o), dv).where("y >= 0")


def pattern_image(mask):
    """Pixels that belong to any order.

    Few pixels lie in two orders, so nothing is gained by combining them before the exchange.
    """
    return spread(mask.select("cal_id", "y", "x"), "cal_id", "y").distinct()


def mask_runs(pattern, dv):
    """Mask of a truncated pattern as stretches of columns ``(cal_id, y, ord, x_from, n)``.

    Columns with the same centre are joined first, so the ``2 dv + 1`` rows are
    unfolded per stretch and not per column; touching stretches of a row are
    joined after that.
    """
    same = W.partitionBy("cal_id", "ord", "yc").orderBy("x")
    steps = (
        pattern.where(F.col("yc").isNotNull())
        .withColumn("island", F.col("x") - F.row_number().over(same))
        .groupBy("cal_id", "ord", "yc", "island").agg(F.min("x").alias("x_from"), F.count("*").alias("n"))
        .select("cal_id", "ord", "x_from", (F.col("x_from") + F.col("n")).alias("x_end"),
                F.explode(F.sequence(F.col("yc") - dv, F.col("yc") + dv)).alias("y"))
        .where("y >= 0")
    )
    row = W.partitionBy("cal_id", "ord", "y").orderBy("x_from")
    return (
        steps.withColumn("starts", (F.coalesce(F.lag("x_end").over(row), F.lit(-1)) != F.col("x_from")).cast("int"))
        .withColumn("stretch", F.sum("starts").over(row))
        .groupBy("cal_id", "y", "ord", "stretch")
        .agg(F.min("x_from").alias("x_from"), F.max("x_end").alias("x_end"))
        .select("cal_id", "y", "ord", "x_from", (F.col("x_end") - F.col("x_from")).alias("n"))
    )


def cut_rows(frame_rows, runs):
    """Order pixels ``(shot, frame, cal_id, ord, y, x, counts)`` of stored image rows.

    ``frame_rows`` carries ``cal_id``; ``runs`` is a saved run table.
    """
    cut = F.slice("row", (F.col("x_from") + 1).cast("int"), F.col("n").cast("int"))
    return (
        attach(frame_rows, runs, ["cal_id", "y"])
        .select("shot", "frame", "cal_id", "ord", "y", "x_from", F.posexplode(cut).alias("i", "counts"))
        .select("shot", "frame", "cal_id", "ord", "y", (F.col("x_from") + F.col("i")).alias("x"), "counts")
    )


def order_spectra(frame_rows, runs):
    """Sum of the strip's rows on every column of every order.

    Sums are combined map-side: with the rows of a frame stored together, a task
    hands on one value per order column instead of one per strip pixel.
    """
    return cut_rows(frame_rows, runs).groupBy("shot", "frame", "cal_id", "ord", "x").agg(
        F.sum("counts").alias("counts"))


def order_image(frame_rows, runs, pattern, dv):
    """Strip of each order straightened along its centre: row ``dy`` in ``0 .. 2 dv``.

    ``pattern`` and ``runs`` are saved tables.
    """
    centre = pattern.select("cal_id", "ord", "x", "yc")
    return attach(cut_rows(frame_rows, runs), centre, ["cal_id", "ord", "x"]).select(
        "shot", "frame", "ord", (F.col("y") - F.col("yc") + dv).alias("dy"), "x", "counts")


def pad_orders(spectra, width, frames=None, pattern=None):
    """Every order of a frame on the full width, missing columns as NULL.

    With ``frames`` (shot, frame, cal_id) and ``pattern`` these tell which orders there
    are, so one wholly off the sensor is padded, too; else those in ``spectra`` do.

    The columns found of an order are packed into one map and read back in full,
    so the padding rows need no join. An order is at most ``width`` columns.
    """
    found = F.map_from_entries(F.collect_list(F.struct("x", "counts")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")))
    packed = spectra.groupBy("shot", "frame", "ord").agg(found.alias("found"))
    if pattern is not None:
        given = attach(frames.select("shot", "frame", "cal_id").distinct(), save(pattern.select("cal_id", "ord").distinct()), ["cal_id"])
        packed = given.select("shot", "frame", "ord").join(packed, ["shot", "frame", "ord"], "left")
    return (
        packed.select("shot", "frame", "ord", "found", every.alias("x"))
        .select("shot", "frame", "ord", "x", F.col("found")[F.col("x")].alias("counts"))
    )


def short_orders(pattern, dv, dim_o, width):
    """Orders shorter than the sensor and the first missing column.

    ``lowest`` is the order's lowest centre: under ``dv``, rows below the sensor
    are left out of its sums.
    """
    on_sensor = truncated_pattern(pattern, dv, dim_o).where(F.col("yc") + dv >= 0)
    length = on_sensor.groupBy("cal_id", "ord").agg((F.max("x") + 1).alias("x_missing"))
    lowest = pattern.groupBy("cal_id", "ord").agg(F.min("yc").alias("lowest"))
    return lowest.join(length.hint("merge"), ["cal_id", "ord"], "left").select(
        "cal_id", "ord", F.coalesce("x_missing", F.lit(0)).alias("x_missing"), "lowest"
    ).where(F.col("x_missing") < width)


def sensor_runs(pattern, dv, dim_o):
    """Saved stretches of all orders as far as they stay on the sensor."""
    return save(mask_runs(truncated_pattern(pattern, dv, dim_o), dv))


def extract(frame_rows, pattern, dv, dim_o):
    """Order spectra from images and pattern in one go."""
    return order_spectra(frame_rows, sensor_runs(pattern, dv, dim_o))
