"""Frame geometry and per-frame arithmetic.

Operators take the long view ``(shot, frame, y, x, counts)`` unless they say
``frame_rows``, the stored layout with one array per image row.
"""

from pyspark.sql import functions as F

from spectralake.storage import attach, save


def transpose(frames):
    """Swap the two image axes: a projection, no data moves."""
    return frames.select("shot", "frame", F.col("x").alias("y"), F.col("y").alias("x"), "counts")


def crop(frame_rows, dims, lo=0, hi=-1):
    """Keep rows ``lo <= y < hi`` and count them from ``lo``.

    Negative bounds count from the sensor's height ``dim_o`` in ``dims(shot, dim_o)``,
    so the default drops the last row.
    """
    bound = lambda b: F.greatest(F.lit(0), F.col("dim_o") + b) if b < 0 else F.lit(b)
    rest = [c for c in frame_rows.columns if c not in ("shot", "frame", "y")]
    return (
        attach(frame_rows, dims.select("shot", "dim_o"), ["shot"])
        .where((F.col("y") >= bound(lo)) & (F.col("y") < bound(hi)))
        .select("shot", "frame", (F.col("y") - bound(lo)).alias("y"), *rest)
    )


def unbin(frame_rows, shots):
    """Repeat every pixel ``ybin`` times down and ``xbin`` times across.

    Works on image rows: rows are repeated by one generator and the pixels
    inside the array, so no pixel row is shuffled or grouped again.
    """
    wide = F.flatten(F.transform("row", lambda v: F.array_repeat(v, F.col("xbin").cast("int"))))
    return (
        attach(frame_rows, shots.select("shot", "xbin", "ybin"), ["shot"])
        .select("shot", "frame", "y", "ybin", wide.alias("row"),
                F.explode(F.sequence(F.lit(0).cast("long"), F.col("ybin") - 1)).alias("dy"))
        .select("shot", "frame", (F.col("y") * F.col("ybin") + F.col("dy")).alias("y"), "row")
    )


def mean_frame(frames):
    """Mean image of a shot."""
    return frames.groupBy("shot", "y", "x").agg(F.avg("counts").alias("counts"))


def diff_frames(spectra, first, count, keys=("shot", "ord", "x")):
    """Mean of ``count`` frames from ``first`` on, minus frame 0."""
    in_run = F.col("frame").between(first, first + count - 1)
    total = F.sum(F.when(in_run, F.col("counts")))
    zero = F.sum(F.when(F.col("frame") == 0, F.col("counts")))
    return spectra.where(in_run | (F.col("frame") == 0)).groupBy(*keys).agg(
        ((total - zero * count) / count).alias("diff"))


def subtract_dark(frames, dark, keys=("y", "x")):
    """Subtract a saved dark image ``(keys, dark)`` pixel by pixel."""
    keys = list(keys)
    return attach(frames, dark.select(*keys, "dark"), keys).withColumn(
        "counts", F.col("counts") - F.col("dark")).drop("dark")


def subtract_dark_rows(frame_rows, dark_rows, keys=("y",)):
    """Subtract a saved dark image of array rows ``(keys, dark)``, image row by image row.

    Both rows are as long as the sensor is wide; no pixel becomes a row of its own. Dark
    rows that no frame asks for are left out before the wide ones are sorted.
    """
    keys = list(keys)
    dark = save(dark_rows.select(*keys, "dark").join(frame_rows.select(*keys).distinct(), keys, "left_semi"))
    return attach(frame_rows, dark, keys).withColumn(
        "row", F.zip_with("row", "dark", lambda a, b: a - b)).drop("dark")


def contrast(frames, percentages=(0.01, 0.99)):
    """Exact display limits of each frame.

    The aggregate holds one counter per distinct count value, which the
    digitiser's depth bounds, and merges map-side.
    """
    levels = F.array(*[F.lit(p) for p in percentages])
    return frames.groupBy("shot", "frame").agg(F.percentile("counts", levels).alias("p")).select(
        "shot", "frame", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def extrema(frames):
    """Smallest and largest pixel of each frame."""
    return frames.groupBy("shot", "frame").agg(
        F.min("counts").alias("low"), F.max("counts").alias("high"))


def extrema_rows(frame_rows):
    """Smallest and largest pixel of each frame, from array rows."""
    return frame_rows.groupBy("shot", "frame").agg(
        F.min(F.array_min("row")).alias("low"), F.max(F.array_max("row")).alias("high"))


def frame_minima(frame_rows):
    """Saved minimum of each frame; array minima are combined map-side."""
    return save(frame_rows.groupBy("shot", "frame").agg(F.min(F.array_min("row")).alias("low")))


def subtract_min(frame_rows):
    """Subtract each frame's minimum.

    Image rows are scanned twice instead of being shuffled: the minima, one
    number per frame, come to the rows.
    """
    low = frame_minima(frame_rows)
    shifted = F.transform("row", lambda v: v - F.col("low"))
    return attach(frame_rows, low, ["shot", "frame"]).select(
        "shot", "frame", "y", shifted.alias("row"))


def blank_outside(frame_rows, slope, below, above):
    """Set pixels under ``int(slope x + below)`` or from ``int(slope x + above)`` up
    to the frame's minimum. A negative limit counts as 0."""
    edge = lambda i, b: F.greatest(F.lit(0), (F.lit(float(slope)) * i + F.lit(float(b))).cast("long"))
    low = frame_minima(frame_rows)
    blanked = F.transform("row", lambda v, i: F.when(
        (F.col("y") < edge(i, below)) | (F.col("y") >= edge(i, above)), F.col("low")).otherwise(v))
    return attach(frame_rows, low, ["shot", "frame"]).select(
        "shot", "frame", "y", blanked.alias("row"))


def dim_mismatch(sphere, dark):
    """Calibration sets whose lamp and dark image differ in unbinned size.

    Both sides are ``(cal_id, dim_w, dim_o, xbin, ybin)``.
    """
    size = lambda df, p: df.select(
        "cal_id", (F.col("dim_w") * F.col("xbin")).alias(f"{p}_w"),
        (F.col("dim_o") * F.col("ybin")).alias(f"{p}_o"))
    return size(sphere, "sphere").join(size(dark, "dark"), "cal_id").where(
        "sphere_w <> dark_w or sphere_o <> dark_o")


def check_dims(sphere, dark):
    """Raise when any calibration set mixes image sizes."""
    bad = dim_mismatch(sphere, dark).limit(5).collect()
    if bad:
        raise ValueError("wrong dark image size: " + "; ".join(
            f"set {r.cal_id}: {r.sphere_w}x{r.sphere_o} vs {r.dark_w}x{r.dark_o}" for r in bad))


def assign_calibration(shots, registry):
    """Calibration set of each shot by sensor size; ``cal_id`` is NULL where none fits.

    The registry must have one row per sensor size to keep one row per shot; of
    several sets of a size the lowest number is taken.
    """
    one = registry.groupBy("dim_w", "dim_o").agg(F.min("cal_id").alias("cal_id"))
    return shots.join(one, ["dim_w", "dim_o"], "left")


def column_slice(frame_rows, columns):
    """Profiles of the named detector columns, as ``(shot, frame, x, y, counts)``."""
    picked = F.array(*[
        F.struct(F.lit(int(c)).cast("long").alias("x"), F.get("row", F.lit(int(c))).alias("counts"))
        for c in columns])
    return (
        frame_rows.select("shot", "frame", "y", F.explode(picked).alias("p"))
        .select("shot", "frame", F.col("p.x").alias("x"), "y", F.col("p.counts").alias("counts"))
        .where(F.col("counts").isNotNull())
    )


def row_slice(frames, y):
    """Profile of one detector row."""
    return frames.where(F.col("y") == y).select("shot", "frame", "x", "counts")
