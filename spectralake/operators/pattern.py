"""Finding the order pattern: profiles across the orders, peaks, curves.

A profile is one detector column ``(shot, frame, x, y, value)``; its length is
the sensor's height, so windows and grouped jobs over ``PROFILE`` stay small.
"""

import functools

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralake.functions import batched, polyfit
from spectralake.operators.frames import column_slice

PROFILE = ("shot", "frame", "x")


def centred_columns(width, step, count):
    """``count`` columns on each side of the centre, ``step`` apart, and the centre."""
    return [width // 2 + step * k for k in range(-count, count + 1)]


def sample_columns(frame_rows, columns):
    """Profiles of the sampled columns; array access, other pixels are not produced."""
    return column_slice(frame_rows, columns)


def smooth_profile(profiles, window, value="counts", keys=PROFILE, order="y"):
    """Savitzky-Golay smoothing of degree 1.

    Inside it is the moving mean; the first and last half window take the
    least-squares line through the end window. ``order`` counts from 0.
    """
    half = window // 2
    part = W.partitionBy(*keys)
    near = part.orderBy(order).rowsBetween(-half, half)
    n = F.count("*").over(part)
    pos, v = F.col(order).cast("double"), F.col(value).cast("double")

    def line(inside):
        y, p = F.when(inside, v), F.when(inside, pos)
        return F.regr_intercept(y, p).over(part) + F.regr_slope(y, p).over(part) * pos

    first, last = F.col(order) < window, F.col(order) >= F.col("n") - window
    return (
        profiles.withColumn("n", n)
        .withColumn("smooth", F.when(F.col(order) < half, line(first))
                    .when(F.col(order) >= F.col("n") - half, line(last))
                    .otherwise(F.avg(v).over(near)))
        .drop("n")
    )


def amplify(profiles, kind, strength, length=None, value="smooth", order="y", name="amplified"):
    """Raise weak orders: ``exp(a y)``, or ``1 + (a (y - length // 2.5))^2``, as column ``name``."""
    pos = F.col(order).cast("double")
    if kind == "exp":
        gain = F.exp(F.lit(float(strength)) * pos)
    else:
        arm = F.lit(float(strength)) * (pos - F.lit(float(length // 2.5)))
        gain = 1 + arm * arm
    return profiles.withColumn(name, F.col(value) * gain)


def poly_baseline(profiles, degree=6, value="amplified", keys=PROFILE, order="y"):
    """Polynomial under each profile, as column ``base``; profiles of one size are projected together."""
    import numpy as np

    def run(batches):
        for batch in batches:
            points, base, settled = batched.Lists(batch.column(0)), [None] * len(batch), [None] * len(batch)
            for size in np.unique(points.sizes[points.sizes > 0]):
                alike = np.flatnonzero(points.sizes == size)
                for rows in np.array_split(alike, max(1, len(alike) * size // batched.CHUNK)):
                    curves, done = batched.polynomial_below(points.padded("v", rows)[0], degree)
                    for i, curve, d in zip(rows, curves, done):
                        base[i], settled[i] = curve, bool(d)
            columns = [pa.array(base, pa.list_(pa.float64())), pa.array(settled, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "base", "converged"])

    source = profiles.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col(order).cast("long").alias(order),
                             F.col(value).cast("double").alias("v"))
    packed = batched.pack(source, keys, [order, "v"]).select("points", *keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    found = packed.mapInArrow(run, f"{fields}, base array<double>, converged boolean")
    rows = found.select(*keys, F.explode(F.arrays_zip("points", "base")).alias("p"), "converged")
    return rows.select(*keys, F.col(f"p.points.{order}").alias(order), F.col("p.points.v").alias("v"), F.col("p.base").alias("base"), "converged")


def local_peaks(profiles, threshold, value="counts", keys=PROFILE, order="y"):
    """Points above both neighbours and above ``threshold`` of the profile's span.

    A flat top counts once, at its left end: it is compared with the next
    value that differs.
    """
    part = W.partitionBy(*keys)
    line = part.orderBy(order)
    v = F.col(value)
    low, high = F.min(v).over(part), F.max(v).over(part)
    rows = (
        profiles.withColumn("before", F.lag(v).over(line))
        .withColumn("level", F.lit(float(threshold)) * (high - low) + low)
    )
    # one row per plateau: drop points equal to their left neighbour
    steps = rows.where(F.col("before").isNull() | (v != F.col("before")))
    return (
        steps.withColumn("after", F.lead(v).over(line))
        .where((v > F.col("before")) & (v > F.col("after")) & (v > F.col("level")))
        .select(*keys, order, v.alias("height"))
    )


def apart_peaks(peaks, distance, keys=PROFILE, order="y"):
    """Peaks with no taller peak within ``distance``; of equals the later stays."""
    near = W.partitionBy(*keys).orderBy(order).rangeBetween(-distance, distance)
    rank = F.struct("height", order)
    return peaks.withColumn("top", F.max(rank).over(near)).where(
        F.col(f"top.{order}") == F.col(order)).drop("top")


def greedy_peaks(peaks, distance, keys=PROFILE, order="y"):
    """Peaks kept from the tallest down, each removing lower ones within ``distance``.

    One fold over the peaks of a profile, in descending height; of equals the
    later goes first.
    """
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("height", order))))
    keep = F.aggregate(
        "ranked", F.filter("ranked", lambda p: F.lit(False)),
        lambda kept, p: F.when(
            F.exists(kept, lambda q: F.abs(q[order] - p[order]) <= distance), kept
        ).otherwise(F.concat(kept, F.array(p))))
    return (
        peaks.groupBy(*keys).agg(ranked.alias("ranked"))
        .select(*keys, F.explode(keep).alias("p"))
        .select(*keys, F.col(f"p.{order}").alias(order), F.col("p.height").alias("height"))
    )


def number_peaks(peaks, keys=PROFILE, order="y"):
    """Order number of each peak: its position in the profile."""
    return peaks.withColumn(
        "ord", F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long") - 1)


def peak_counts(peaks):
    """Peak count of each sampled column, and whether all columns of a frame agree."""
    counts = peaks.groupBy("shot", "frame", "x").agg(F.count("*").alias("n"))
    whole = counts.groupBy("shot", "frame").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("columns"))
    return whole.withColumn("consistent", F.col("least") == F.col("most"))


def apply_overrides(peaks, dropped, added, keys=PROFILE, order="y"):
    """Remove and insert peaks by hand, then number them anew."""
    on = [*keys, order]
    kept = peaks.select(*on).join(dropped.select(*on), on, "left_anti")
    return number_peaks(kept.unionByName(added.select(*on)), keys, order)


def fit_curve(peaks, degree, keys=("shot", "frame", "ord"), x="x", y="y", origin=0.0):
    """Order curve ``y(x)``; missing peaks are left out."""
    return polyfit.fit_polynomial(peaks, list(keys), x, y, origin=origin, max_degree=degree)


def eval_curve(fits, width, height, origin=0.0):
    """Row centre on every column, cut to whole rows; NULL outside ``[0, height]``."""
    y = polyfit.evaluate(F.col("x").cast("double"), origin=origin)
    return (
        fits.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
        .withColumn("at", y)
        .withColumn("yc", F.when(F.col("at").between(0, height), F.col("at")).cast("long"))
        .drop("at", "n", "degree", "c0", "c1", "c2")
    )


def order_spacing(peaks, keys=PROFILE, order="y"):
    """Distance between orders: gradient of the peak rows, smoothed by a quartic.

    ``ord`` counts the found peaks. The quartic is a projection on orthogonal
    polynomials of an equally spaced grid, so it is four sums per profile. A single
    peak has NULL spacing.
    """
    part = W.partitionBy(*keys)
    line = part.orderBy("ord")
    y = F.col(order).cast("double")
    before, after = F.lag(y).over(line), F.lead(y).over(line)
    steps = (
        peaks.withColumn("m", F.count("*").over(part).cast("double"))
        .withColumn("spacing", F.when(before.isNull(), after - y).when(after.isNull(), y - before)
                    .otherwise((after - before) / 2))
        .withColumn("t", F.col("ord").cast("double") - (F.col("m") - 1) / 2)
    )
    for k, p in enumerate(polyfit.gram_basis(F.col("t"), F.col("m"))):
        steps = steps.withColumn(f"p{k}", F.when(F.col("m") > k, p).otherwise(0.0))
    weights = []
    for k in range(5):
        p = F.col(f"p{k}")
        norm = F.sum(p * p).over(part)
        weights.append(F.when(F.col("m") > k, p * F.sum(p * F.col("spacing")).over(part) / norm).otherwise(0.0))
    return steps.withColumn("smooth_spacing", functools.reduce(lambda a, b: a + b, weights)).select(
        *keys, "ord", order, "spacing", "smooth_spacing")


def order_profile(profiles, spacing, height, margin=10):
    """Cross-section ``[Y - w, Y + w)`` of each order, scaled to 0..1.

    ``w`` is half the order spacing plus ``margin``, shrunk until it fits the
    image. Profiles are cut by array slicing: a column is one array with a place for
    every image row, NULL where the row is lost. An order without
    spacing, or at the image's edge, has one row with NULL ``dy`` and ``z``.
    """
    found = profiles.select("shot", "frame", "x", F.col("y").cast("long").alias("y"), "counts").groupBy("shot", "frame", "x").agg(
        F.collect_list(F.struct("y", "counts")).alias("found"))
    # rows that are lost keep their place
    rows = F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))
    lost = F.array_except(rows, F.transform("found", lambda p: p["y"]))
    kind = found.schema["found"].dataType.elementType["counts"].dataType
    lost = F.transform(lost, lambda y: F.struct(y.alias("y"), F.lit(None).cast(kind).alias("counts")))
    columns = found.select("shot", "frame", "x", F.transform(
        F.array_sort(F.concat("found", lost)), lambda p: p["counts"]).alias("column"))
    half = (F.col("smooth_spacing") / 2).cast("long") + margin
    w = F.when(half.isNotNull(), F.least(half, F.col("yc"), F.lit(height).cast("long") - F.col("yc")))
    span = F.col("high") - F.col("low")
    return (
        spacing.withColumnRenamed("y", "yc").withColumn("w", w).withColumn("w", F.when(F.col("w") > 0, F.col("w")))
        .join(columns, ["shot", "frame", "x"])
        .withColumn("cut", F.slice("column", (F.col("yc") - F.col("w") + 1).cast("int"),
                                   (2 * F.col("w")).cast("int")))
        .withColumn("low", F.array_min("cut")).withColumn("high", F.array_max("cut"))
        .select("shot", "frame", "x", "ord", "w", "low", "high", F.posexplode_outer("cut").alias("i", "counts"))
        .select("shot", "frame", "x", "ord", (F.col("i") - F.col("w")).alias("dy"),
                ((F.col("counts") - F.col("low")) / F.when(span != 0, span)).alias("z"))
    )


def fit_profile(profiles, extra=2):
    """Order shape as tied Gaussians: main, left and right neighbour and ``extra``
    shifted copies of the main one; many cross-sections at once.

    Fixed parameter boxes: widths 10..15 pixels (right neighbour from 0),
    amplitudes up to 200, neighbour distance ``w``..``1.5 w``, shift up to ``w / 5``. One
    row per cross-section: with fewer points than parameters and two, the values are NULL.
    """
    import numpy as np

    def fit(points, batch, rows):
        x, z = points.padded("dy", rows)[0], points.padded("z", rows)[0]
        here = np.isfinite(z)
        w = -np.nanmin(np.where(here, x, np.nan), axis=1, initial=np.inf, where=here)
        able = here.sum(1) >= 5 + 2 * (3 + extra)
        w = np.where(able, w, 1.0)
        x, pair, ones = np.nan_to_num(x), [100.0, 10.0] * (3 + extra), np.ones(len(rows))

        def model(p, k):
            centre, shift, distance = p[..., :1], p[..., 1:2], p[..., 2:3]
            middles = np.concatenate([centre, centre - distance, centre + distance,
                                      *[centre + shift * (i + 1) for i in range(extra)]], axis=-1)
            return batched.gaussians(x[k], p[..., 3::2], middles, p[..., 4::2])

        # the box of a cross-section depends on its own width
        start = np.column_stack([0 * w, 0 * w, w, *[v * ones for v in pair]])
        low = np.column_stack([-w / 2, -w / 5, w, *[v * ones for v in [1.0, 10.0, 0.0, 10.0, 0.0, 0.1] + [1.0, 10.0] * extra]])
        high = np.column_stack([w / 2, w / 5, 1.5 * w, *[v * ones for v in [200.0, 15.0] * (3 + extra)]])
        p, sse, settled = batched.least_squares(model, z, here & able[:, None], start, low, high)
        p[~able], sse[~able] = np.nan, np.nan
        return p[:, 0], p[:, 4], sse, settled

    key = ["shot", "frame", "x", "ord"]
    return batched.solved(batched.pack(profiles, key, ["dy", "z"]), fit, ["centre", "sigma", "sse"]).drop("points")
