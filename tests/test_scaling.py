"""Plans that large tables need: no broadcast of unfolded rows, no unfolding in one task."""

import pytest
from pyspark.sql import functions as F

from spectralake.operators import absolute, extraction, frames, wavelength
from spectralake.storage import attach, save
from workload import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(20).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    return str(tmp_path)


def test_saved_table_beyond_the_limit_is_not_broadcast(spark):
    dim = save(spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    fact = spark.range(1000).select((F.col("id") % 100).alias("k"))
    large, small = attach(fact, dim, ["k"], max_rows=99), attach(fact, dim, ["k"], max_rows=100)
    assert "Broadcast" not in plan(large) and "BroadcastHashJoin" in plan(small)
    assert large.count() == small.count() == 1000


def test_sets_and_slices_are_unfolded_by_many_tasks(spark, tables):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ratios = spark.createDataFrame([("b692", 692.0, 0.0, 1.0)], "band string, wl0 double, offset double, ratio double")
    for df, rows in ((views.images(spark, tables), 20 * 25), (views.pattern(spark, tables), 20 * 4 * 64), (views.knots(spark, tables), 20 * 26),
                     (views.planted_windows(spark, tables), 20 * 4 * 20), (views.straight_slices(spark, tables), 20 * 40),
                     (views.planted_slices(spark, tables, ratios), 4 * 66)):
        assert df.rdd.getNumPartitions() == n and df.count() == rows


def test_unfolded_knots_are_not_broadcast(spark, tables):
    points = spark.createDataFrame([(1, 0, 0, 500.0), (1, 0, 1, 200.0)], "cal_id long, ord long, x long, wl double")
    got = absolute.irradiance_linear(points, views.knots(spark, tables))
    assert "Broadcast" not in plan(got)
    assert {r.x: r.irradiance is None for r in got.collect()} == {0: False, 1: True}


def test_pixels_of_a_mask_are_combined_behind_the_exchange_only(spark):
    mask = spark.createDataFrame([(1, 0, 3, 5), (1, 1, 3, 5), (2, 0, 3, 5), (1, 0, 4, 5), (None, 0, 4, 5)], "cal_id long, ord long, x long, y long")
    got = extraction.pattern_image(mask)
    lines = plan(got).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert not any("Aggregate" in line for line in lines[exchange:])
    assert sorted(map(tuple, got.na.fill(0).collect())) == [(0, 5, 4), (1, 5, 3), (1, 5, 4), (2, 5, 3)]


@pytest.fixture
def sums(spark):
    """Wavelengths and sphere of two orders: saved tables, small as files."""
    rows = save(spark.range(40).select(F.lit(1).cast("long").alias("cal_id"), (F.col("id") % 2).alias("ord"), F.expr("id div 2").alias("x")))
    wl = save(rows.withColumn("wl", 700.0 - 5 * F.col("ord") - F.col("x")))
    return wl, save(rows.withColumn("counts", F.when(F.col("ord") == 0, 10 + F.col("x")).otherwise(30 - F.col("x"))))


def test_saved_sums_are_not_broadcast(spark, sums):
    wl, sphere = sums
    flat = wavelength.flat_field(sphere, sphere)
    lines = save(spark.createDataFrame([(1, 0, 8), (1, 1, 4)], "cal_id long, ord long, px0 long"))
    windows = wavelength.line_windows(flat, lines, 4)
    short = save(spark.createDataFrame([(1, 0, 12)], "cal_id long, ord long, x_missing long"))
    blank = wavelength.blank_short(wl, short)
    for df, rows in ((flat, 40), (windows, 16), (blank, 40)):
        assert "Broadcast" not in plan(df) and df.count() == rows
    assert blank.where("wl is null").count() == 8
    assert flat.where("ord = 1").agg(F.min("flat")).first()[0] == 0


def test_crossings_join_saved_sums_by_shuffle_and_read_windows_once(sums, monkeypatch):
    monkeypatch.setattr(wavelength, "save", lambda df: df)
    wl, sphere = sums
    every, nearest = wavelength.all_crossings(wl, sphere), wavelength.order_crossings(wl, sphere)
    for df in (every, nearest):
        assert "Broadcast" not in plan(df)
    # a frame that ends with the partition is read anew for each of its rows
    assert "currentrow$(), unboundedfollowing" not in plan(every).lower()
    # 10 + 700 - w meets 30 - (695 - w) at w = 687.5
    assert [(r.ord, r.next_ord, r.wl, r.level) for r in every.collect()] == [(0, 1, 687.5, 22.5)]
    assert abs(nearest.first().cross - 687.5) < 0.5


def test_lamp_adds_up_line_items_before_they_are_unfolded(spark, tmp_path):
    rows = [(1, 0, 5, 1, 2.0), (1, 0, 5, 1, 3.0), (1, 2, 5, 1, 1.0), (1, 0, 5, 2, None), (None, 0, 5, 1, 4.0), (1, None, 5, 1, 4.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = views.lamp(spark, str(tmp_path))
    want = {}
    for order, part, supp, line, quantity in rows:
        for d, w in ((-2, 1), (-1, 3), (0, 5), (1, 3), (2, 1)):
            key = (supp, line - 1, None if None in (order, part) else (order * 3 + part) % 64 + d)
            want[key] = want.get(key) if quantity is None else (want.get(key) or 0) + int(quantity) * w
    assert {(r.cal_id, r.ord, r.x): r.counts for r in got.collect()} == want
    lines = plan(views.lamp(spark, str(tmp_path))).splitlines()
    unfolded = next(i for i, line in enumerate(lines) if "Generate" in line)
    assert any("Exchange" in line for line in lines[unfolded:])


def test_dark_rows_without_frames_are_not_joined(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(frames, "attach", lambda fact, dim, on: joined.append(dim.count()) or attach(fact, dim, on))
    rows = spark.createDataFrame([(0, 0, 1, 0, [5, 7]), (0, 1, 1, 0, [6, None]), (0, 0, None, 0, [1, 1])], "shot long, frame long, cal_id long, y long, row array<long>")
    dark = save(spark.range(50).select(F.col("id").alias("cal_id"), F.lit(0).cast("long").alias("y"), F.expr("array(id, 2)").alias("dark")))
    got = frames.subtract_dark_rows(rows, dark, ("cal_id", "y"))
    assert sorted(r.row for r in got.collect()) == [[4, 5], [5, None]] and joined == [1]
