"""Stores in buckets: what is read from them needs no exchange, in any session."""

import os

from pyspark.sql import functions as F

from spectralake.operators import background, bands, extraction, packed
from spectralake.sources import bucketed
from spectralake.storage import save


def moved(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]


def images(spark):
    return spark.range(600).select(
        F.expr("id div 200").alias("shot"), F.expr("id % 200 div 20").alias("frame"), (F.col("id") % 20).alias("y"),
        F.lit(1).cast("long").alias("cal_id"), F.transform(F.sequence(F.lit(0), F.lit(29)), lambda x: F.col("id") % 7 + x).alias("row"))


def test_orders_quiet_frames_and_slices_without_exchange(spark, tmp_path):
    stored = bucketed.write_store(images(spark), str(tmp_path / "images"), order=("y",))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, images(spark).select(stored.columns).collect()))
    pattern = spark.range(60).select(F.lit(1).cast("long").alias("cal_id"), F.expr("id div 30").alias("ord"),
                                     (F.col("id") % 30).alias("x"), (4 + 8 * F.expr("id div 30")).alias("yc"))
    runs = extraction.sensor_runs(pattern, 2, 20)
    sums = extraction.order_spectra(stored, runs)
    assert moved(sums) == [] and moved(extraction.order_spectra(images(spark), runs))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, extraction.order_spectra(images(spark), runs).collect()))
    spectra = bucketed.write_store(sums, str(tmp_path / "sums"), order=("ord", "x"))
    quiet = background.quiet_frames(spectra)
    assert moved(quiet) == []
    table = save(spark.createDataFrame([("b", 500.0, 510.0)], "band string, lo double, hi double"))
    points = bands.band_slices(spectra.withColumn("wl", 500.0 + F.col("x")).withColumn("seq", F.col("x")).withColumn("wm", F.col("counts")), table)
    assert moved(bands.subtract_line(points)) == [] and moved(bands.integrate(bands.subtract_line(points))) == []
    assert quiet.count() == 30 and bands.integrate(bands.subtract_line(points)).count() == 30


def test_packed_spectra_from_images_are_stored_without_a_second_exchange(spark, tmp_path):
    pattern = spark.range(30).select(F.lit(1).cast("long").alias("cal_id"), F.lit(0).cast("long").alias("ord"), F.col("id").alias("x"), F.lit(6).cast("long").alias("yc"))
    runs = save(packed.pack_runs(extraction.sensor_runs(pattern, 2, 20)))
    sums = packed.frame_sums(images(spark), runs)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(moved(sums.repartition(n, "shot", "frame"))) == len(moved(sums)) == 1
    stored = bucketed.save_store(sums, order=("ord",))
    assert moved(packed.quiet_frames(stored)) == [] and packed.quiet_frames(stored).count() == 30


def test_open_in_another_session(spark, tmp_path):
    path = str(tmp_path / "it's a store")
    bucketed.write_store(images(spark), path, buckets=3)
    other = spark.newSession()
    again = bucketed.open_store(other, path)
    assert again.count() == 600 and moved(again.groupBy("shot", "frame").count()) == []
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3
    nothing = bucketed.write_store(images(spark).where("false"), str(tmp_path / "none"))
    assert nothing.collect() == [] and nothing.columns == images(spark).columns
