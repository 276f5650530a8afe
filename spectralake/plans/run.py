"""A run over all shots that can be stopped and taken up again.

The folder of a run holds spectra by shot (Parquet), one text file of intensities per shot,
the intensities as a table, and a manifest of finished shots. A batch of shots enters the
manifest after all its outputs are there, so what a lost run left half done is done again
and written over; what is finished is not touched, unless asked for.
"""

import time
import uuid

from pyspark.sql import functions as F

from spectralake.operators import bands, packed
from spectralake.operators.shots import pending
from spectralake.plans import products
from spectralake.sinks import text
from spectralake.storage import save

MANIFEST = "shot long, batch string"
VALUES = "shot long, frame long, band string, intensity double, batch string"


def _table(spark, path, schema):
    """The rows of a folder of batches; none before the first one."""
    spark.createDataFrame([], schema).limit(0).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def finished(spark, folder):
    """Shots that are done."""
    return _table(spark, f"{folder}/manifest", MANIFEST).select("shot").distinct()


def intensities(spark, folder):
    """``(shot, frame, band, intensity)`` of finished shots: those of the last batch that finished each."""
    done = _table(spark, f"{folder}/manifest", MANIFEST).groupBy("shot").agg(F.max("batch").alias("batch"))
    return _table(spark, f"{folder}/intensities", VALUES).join(done, ["shot", "batch"]).drop("batch")


def process(frame_rows, shots, calibration, band_table, folder, date, k=5.0, pad=0.1, lines=None, fitted=(), redo=False):
    """Process the shots that are not finished and list them; returns those of this run, saved.

    ``frame_rows`` is ``(shot, frame, y, row, cal_id)``, best a store in buckets; ``shots``
    is saved, one row per shot with exposure, times and ``n_frames``. Bands named in
    ``fitted`` take the fitted intensity where a line stands out. With ``redo`` all shots
    are processed again.
    """
    spark = frame_rows.sparkSession
    todo = save(pending(shots.select("shot"), finished(spark, folder), overwrite=redo))
    if todo.isEmpty():
        return todo
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"      # later ones sort behind
    meta = save(shots.join(todo, "shot", "left_semi"))
    rows = frame_rows.join(todo, "shot", "left_semi")
    spectra, _ = products.calibrated_spectra(rows, calibration, meta, k)
    text.write_spectra(packed.unpacked(spectra, ["wm"], ("seq", "wl")).select("shot", "frame", "seq", "wl", "wm"), f"{folder}/spectra")
    values = save(products.intensities(spectra, calibration, band_table, meta, lines, fitted, pad))
    names = [r["band"] for r in band_table.select("band").orderBy("band").collect()]
    table = products.intensity_table(values, meta, names)
    text.write_shot_files(text.intensity_lines(table, names, meta, "lines", date), f"{folder}/text")
    values.withColumn("batch", F.lit(batch)).select(*[f.split()[0] for f in VALUES.split(", ")]).write.mode("append").parquet(f"{folder}/intensities")
    todo.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/manifest")
    return todo


def table(spark, folder, shots, band_order):
    """Time by band table of all finished shots."""
    return bands.intensity_table(bands.with_time(intensities(spark, folder), shots), band_order)
