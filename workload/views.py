"""Spectrograph tables derived from the given test tables.

Each view exists twice: as a DataFrame here and as SQL in ``sql.py``.
All counts are whole numbers, so sums are exact on both sides.
"""

from pyspark.sql import functions as F

from spectralake.sources.shots import pixels
from spectralake.storage import dealt

# Sensor of the image stacks: rows of 64 columns, 25 rows, 10 frames a shot.
DIM_W, DIM_O, DV = 64, 25, 2
SETS = 10


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


def _sets(spark, sf_dir):
    """Calibration sets, one per supplier, dealt out to be unfolded."""
    return dealt(table(spark, sf_dir, "supplier").select(_long("s_suppkey").alias("cal_id")), "cal_id")


def span(n):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def frame_rows_of(vectors):
    """Image rows: a vector is one row of 64 pixels."""
    v = F.col("vec_id")
    return vectors.select(
        F.expr("vec_id div 250").alias("shot"), F.expr("vec_id % 250 div 25").alias("frame"),
        (v % 25).alias("y"), F.expr("vec_id div 250 % 10").alias("cal_id"),
        F.transform("embedding", lambda e: F.round((e.cast("double") + 1) * 1000).cast("long")).alias("row"))


def frame_rows(spark, sf_dir):
    return frame_rows_of(table(spark, sf_dir, "embeddings"))


def frames(spark, sf_dir):
    return pixels(frame_rows(spark, sf_dir))


def stacks(spark, sf_dir):
    """One row per image stack."""
    return frame_rows(spark, sf_dir).groupBy("shot", "cal_id").agg(
        (F.max("frame") + 1).alias("n_frames")).select(
        "shot", "cal_id", "n_frames", (F.lit(0.1) * (F.col("shot") + 1)).alias("exposure_s"),
        F.lit(0.25).alias("cycle_s"), F.lit(2.75).alias("trig_delay_s"),
        (1 + F.col("shot") % 2).alias("xbin"), F.lit(2).cast("long").alias("ybin"),
        F.lit(DIM_W).cast("long").alias("dim_w"), F.lit(DIM_O).cast("long").alias("dim_o"))


def shots(spark, sf_dir):
    """One shot per order row, with its file."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (100000 + k).alias("shot"), "o_orderdate", "o_orderstatus",
        F.concat(F.lit("data/"), (k % 7).cast("string"), F.lit("/"), (100000 + k).cast("string"),
                 F.lit("_image.SIF")).alias("path"),
        (1 + k % 50).alias("n_frames"), (F.lit(0.1) * (1 + k % 9)).alias("exposure_s"),
        F.lit(0.25).alias("cycle_s"), F.lit(2.75).alias("trig_delay_s"),
        (1 + k % 2).alias("xbin"), (1 + k % 3).alias("ybin"),
        F.when(k % 5 == 4, 2048).otherwise(1024).cast("long").alias("dim_w"),
        F.when(k % 11 == 10, 100).when(k % 5 == 4, 2048).otherwise(1024).cast("long").alias("dim_o"))


def pattern(spark, sf_dir, orders=4):
    """Four curved orders per calibration set; a set is one supplier row. A fifth one would lie off the sensor."""
    s = _sets(spark, sf_dir)
    return (
        s.select("cal_id", F.explode(span(orders)).alias("ord"))
        .select("cal_id", "ord", F.explode(span(DIM_W)).alias("x"))
        .withColumn("yc", 3 + 6 * F.col("ord") + F.expr("x div 24") + F.col("cal_id") % 2)
    )


def line_list(spark, sf_dir):
    """Calibration lines measured for a set: one per line item."""
    li = table(spark, sf_dir, "lineitem").select(
        _long("l_suppkey").alias("cal_id"), ((_long("l_linenumber") - 1) % 4).alias("ord"),
        ((F.col("l_orderkey") * 3 + F.col("l_partkey")) % 64).cast("double").alias("px"),
        (F.col("l_quantity") % 3 - 1).alias("wobble"))
    px = F.col("px")
    return li.select("cal_id", "ord", "px", F.round(
        F.lit(700.0) - 20.0 * F.col("ord") - F.lit(0.4) * px - F.lit(0.0005) * px * px
        + F.lit(0.001) * F.col("wobble"), 4).alias("wl"))


def lamp(spark, sf_dir):
    """Lamp order spectra: every line item adds a small peak of five columns.

    Line items of a column are added up before they are unfolded; orders are whole then.
    """
    shape = F.array(*[F.struct(F.lit(d).cast("long").alias("d"), F.lit(w).cast("long").alias("w"))
                      for d, w in ((-2, 1), (-1, 3), (0, 5), (1, 3), (2, 1))])
    return (
        table(spark, sf_dir, "lineitem").select(
            _long("l_suppkey").alias("cal_id"), ((_long("l_linenumber") - 1) % 4).alias("ord"),
            ((F.col("l_orderkey") * 3 + F.col("l_partkey")) % 64).alias("px"),
            _long("l_quantity").alias("q"))
        .groupBy("cal_id", "ord", "px").agg(F.sum("q").alias("q")).repartition("cal_id", "ord")
        .withColumn("s", F.explode(shape))
        .groupBy("cal_id", "ord", (F.col("px") + F.col("s.d")).alias("x"))
        .agg(F.sum(F.col("q") * F.col("s.w")).alias("counts"))
    )


def lamp_lines(spark, sf_dir):
    """Lines of single lamp exposures: few per order, so the degree varies."""
    li = table(spark, sf_dir, "lineitem").select(
        _long("l_orderkey").alias("cal_id"), (_long("l_linenumber") % 2).alias("ord"),
        (9.0 * F.col("l_linenumber") + F.col("l_partkey") % 7 + 0.25).alias("px"),
        (F.col("l_suppkey") % 5).cast("double").alias("wobble"))
    px = F.col("px")
    return li.select("cal_id", "ord", "px", F.round(
        F.lit(700.0) - 20.0 * F.col("ord") - F.lit(0.4) * px - F.lit(0.0005) * px * px
        + F.lit(0.01) * F.col("wobble"), 4).alias("wl"))


def images(spark, sf_dir):
    """Sphere and dark image rows of each set."""
    s = _sets(spark, sf_dir)
    y = F.col("y")
    sphere = lambda x: 1000 - F.floor((x - 32) * (x - 32) / 2) + y + F.col("cal_id") % 5
    dark = lambda x: 50 + (x + y + F.col("cal_id")) % 3
    return s.select("cal_id", F.explode(span(DIM_O)).alias("y")).select(
        "cal_id", "y", F.transform(span(DIM_W), sphere).alias("sphere"),
        F.transform(span(DIM_W), dark).alias("dark"))


def knots(spark, sf_dir):
    """Lamp irradiance knots of each set, 26 from 300 to 2400 nm."""
    s = _sets(spark, sf_dir)
    i = F.col("i").cast("double")
    return s.select("cal_id", F.explode(span(26)).alias("i")).select(
        "cal_id", ((300 + 84 * F.col("i")) / 1000).alias("um"),
        ((i + 1) * (i + 1) * (30 - i) / 20 + F.col("cal_id") % 7).alias("mw"))


def exposures(spark, sf_dir):
    """Sphere exposure of each set."""
    return table(spark, sf_dir, "supplier").select(
        _long("s_suppkey").alias("cal_id"), (F.lit(0.5) + F.lit(0.25) * (F.col("s_nationkey") % 3)).alias("exposure_s"))


def bands(spark):
    """Bands of the stacks: a fixed table of five."""
    return spark.createDataFrame(
        [("b692", "H", 690.0, 694.0), ("b684", "H", 682.0, 686.0), ("b668", "He", 666.0, 670.0),
         ("b650", "C", 648.0, 652.0), ("b630", "C", 628.0, 632.0)],
        "band string, grp string, lo double, hi double")


def band_lines_small(spark):
    """Lines of the five bands."""
    return spark.createDataFrame(
        [("b692", 0, 692.0, 1.0, "2s-3s", "1/2-3/2"), ("b684", 0, 683.5, 2.0, "2s-3p", "*-*"),
         ("b684", 1, 684.6, 1.0, "2s-3p", "0-1"), ("b668", 0, 667.4, 1.0, "2s-3d", "1-2"),
         ("b668", 1, 668.2, 1.5, "2s-3d", "1-3"), ("b668", 2, 668.9, 0.5, "2s-3d", "1-1"),
         ("b650", 0, 650.0, 3.0, "2p-4d", "*-*"), ("b630", 0, 630.2, 1.0, "2p-4s", "1-0")],
        "band string, line long, wl double, ak double, config string, j string")


def atomic_lines(spark, sf_dir):
    """Spectral lines with level labels, one per part row, four to a band."""
    k = F.col("p_partkey")
    upper = F.array(*[F.lit(v) for v in ("1/2", "3/2", "5/2", "1 1/2", "2", "0", "*", "3")])
    letter = F.substring(F.lit("spdfghik"), (F.expr("p_partkey div 3") % 8 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("B"), (F.expr("p_partkey div 4")).cast("string"), F.lit("-"), F.get(
            F.array(F.lit("ECONOMY"), F.lit("SMALL"), F.lit("LARGE")), F.expr("cast(p_partkey div 4 % 3 as int)"))).alias("band"),
        k.alias("line"),
        (F.lit(400.0) + (k * 37 % 4001) / F.lit(9.97)).alias("wl"),
        F.concat(F.lit("1s2.2p-1s2."), (k % 7 + 2).cast("string"), letter).alias("config"),
        F.concat(F.lit("1/2-"), F.get(upper, (k % 8).cast("int"))).alias("j"),
        (F.col("p_size").cast("double") * 1e6 + k * F.lit(1.7123457)).alias("ak"),
        (F.lit(20.0) + k % 100 / 8).alias("e_low"), (F.lit(22.0) + k % 100 / F.lit(4.03)).alias("e_high"))


def measured(spark, sf_dir):
    """Spectral points over the catalogue's range, one per line item."""
    k = F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        _long("l_suppkey").alias("shot"), _long("l_linenumber").alias("frame"),
        (F.lit(400.0) + (k % 40001) / 100).alias("wl"), F.col("l_orderkey").alias("seq"),
        F.col("l_quantity").cast("long").alias("counts"))


def event_spectra(spark, sf_dir):
    """Ten-point spectra, 100 frames a shot, one point per event."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 1000").alias("shot"), F.expr("event_id % 1000 div 10").alias("frame"),
        F.lit(0).cast("long").alias("ord"), (F.col("event_id") % 10).alias("x"),
        F.round(F.col("value") * 100).cast("long").alias("counts"))


def event_values(spark, sf_dir):
    """Intensities: one band value per event, 100 frames a shot."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 100").alias("shot"), (F.col("event_id") % 100).alias("frame"),
        F.col("event_type").alias("band"), F.col("value").alias("intensity"))


def event_shots(spark, sf_dir):
    """One row per shot of the event views."""
    return table(spark, sf_dir, "events").groupBy(F.expr("event_id div 100").alias("shot")).agg(
        F.lit(100).cast("long").alias("n_frames"), F.lit(0.25).alias("cycle_s"), F.lit(2.75).alias("trig_delay_s"),
        F.lit(0.5).alias("exposure_s"))


def order_peaks(spark, sf_dir):
    """Peak rows found on sampled columns of an order, one per line item."""
    x = ((F.col("l_orderkey") * 3 + F.col("l_partkey")) % 64)
    return table(spark, sf_dir, "lineitem").select(
        _long("l_suppkey").alias("shot"), F.lit(0).cast("long").alias("frame"),
        (_long("l_linenumber") - 1).alias("ord"), x.alias("x"),
        F.when(F.col("l_partkey") % 10 != 9, 3 + 6.0 * (F.col("l_linenumber") - 1) + F.lit(0.05) * x
               + F.lit(0.001) * x * x + (F.col("l_quantity") % 3) / 2).alias("y"))


def _bell(x, area, centre, sigma):
    return area / (F.lit(2.5066282746310002) * sigma) * F.exp(-(x - centre) * (x - centre) / (2 * sigma * sigma))


def planted_slices(spark, sf_dir, ratios):
    """Slices of one band each, made of its lines with known parameters, one per customer."""
    k = F.col("shot")
    lines = ratios.groupBy("band").agg(F.first("wl0").alias("wl0"), F.collect_list(F.struct("offset", "ratio")).alias("lines"))
    truth = dealt(table(spark, sf_dir, "customer"), "c_custkey").select(
        _long("c_custkey").alias("shot"), F.lit(0).cast("long").alias("frame"),
        F.get(F.array(*[F.lit(b) for b in ("b692", "b684", "b668", "b650", "b630")]), (F.col("c_custkey") % 5).cast("int")).alias("band"))
    rows = truth.join(F.broadcast(lines), "band").withColumn("seq", F.explode(span(66)))
    wl = F.col("wl0") - 2.5 + F.lit(0.1) * F.col("seq")
    centre, sigma, delta = F.col("wl0") + (k % 7 - 3) * F.lit(0.02), 0.4 + F.lit(0.05) * (k % 9), 1.0 + k % 13
    y = F.aggregate("lines", F.lit(0.0), lambda s, l: s + _bell(wl, delta * l["ratio"], centre + l["offset"], sigma))
    return rows.select("shot", "frame", "band", wl.alias("wl"), "seq", y.alias("y"))


def planted_windows(spark, sf_dir):
    """Windows around lamp lines with known parameters, four per calibration set."""
    k, o = F.col("cal_id"), F.col("ord")
    rows = _sets(spark, sf_dir).select("cal_id", F.explode(span(4)).alias("ord"))
    rows = rows.withColumn("px0", 20 + (k + 3 * o) % 30).withColumn("x", F.explode(F.sequence(F.col("px0") - 10, F.col("px0") + 9)))
    level = _bell(F.col("x").cast("double"), 50.0 + k % 30, F.col("px0") + F.lit(0.25) * (k % 11 - 5), 1.2 + F.lit(0.1) * ((k + o) % 7))
    return rows.select("cal_id", "ord", "px0", "x", level.alias("level"))


def straight_slices(spark, sf_dir):
    """Slices whose points lie on a line, one per calibration set; the middle is the core."""
    k, i = _long("s_suppkey"), F.col("seq")
    rows = dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(k.alias("shot"), F.lit(0).cast("long").alias("frame"), F.lit("flat").alias("band"), F.explode(span(40)).alias("seq"))
    return rows.select("shot", "frame", "band", (500.0 + i / 8).alias("wl"), "seq", (3.0 + F.col("shot") % 5 + i * (F.col("shot") % 4) / 5).alias("y"),
                       i.between(10, 29).alias("core"))
