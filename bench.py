"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores. Each query is
run in full into a sink that drops its rows; the first query warms the session.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from spectralake.operators import extraction  # noqa: E402
from spectralake.session import build_session, ship  # noqa: E402
from workload import queries as q  # noqa: E402
from workload import views as v  # noqa: E402

HEADLINE = [
    "order_spectra", "pad_orders", "contrast", "unbin", "savgol", "peaks", "order_profile",
    "line_list", "dispersion_fit", "wavelength_map", "order_crossings", "stitched_spectra", "calibrated",
    "quiet_frames", "longest_run", "bg_subtract", "band_lines", "band_intensity", "band_fit_grid",
    "intensity_pivot", "export_intensities", "full_chain",
]


def stack_copies(spark, sf_dir):
    """Order spectra of fifty copies of every stack: 64 pixels a row, 6.4 million at sf0.1."""
    rep = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")))
    rows = v.frame_rows(spark, sf_dir).withColumn("rep", rep).repartition(64).select(
        (F.col("shot") * 50 + F.col("rep")).alias("shot"), "frame", "y", "cal_id",
        F.transform("row", lambda c: c + F.col("rep")).alias("row"))
    runs = extraction.sensor_runs(v.pattern(spark, sf_dir), v.DV, v.DIM_O)
    return extraction.order_spectra(rows, runs)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k"})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)

    def run(query):
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(q.QUERIES["order_spectra"])
    times = {name: run(q.QUERIES[name]) for name in HEADLINE}
    times["order_spectra_50_copies"] = run(stack_copies)
    spark.stop()
    print(json.dumps({
        "metric": "spectrograph_headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
