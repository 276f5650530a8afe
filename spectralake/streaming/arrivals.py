"""Shots as they arrive: a file stream of image rows, processed once complete."""

from pyspark.sql import functions as F

from spectralake.operators.shots import pending
from spectralake.storage import attach, save
from spectralake.streaming import completeness


def arriving_rows(spark, folder, schema, glob="*.parquet", files_per_trigger=None):
    """File stream of new Parquet files in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def process_arrivals(frame_rows, expected, process, folder, trigger=None, keep_ms=completeness.KEEP_MS):
    """Land arriving rows and process each shot when it is complete; returns the second query.

    ``frame_rows`` is a stream of ``(shot, frame, y, ...)``; ``expected`` is
    ``(shot, n_frames, height)``, saved; ``process`` maps the rows of complete shots to a
    table with ``shot``. A background run needs the whole shot, so a first query lands
    rows by shot, each once. A second one reads keys of newly landed rows only and keeps
    as state which of them have come (``completeness``). When a shot is complete, its
    landed folder is read and processed; rows that came several times count once, and those
    outside the shot's size not at all.

    Every batch writes its own folder by overwriting it, so a batch that is replayed after
    a failure gives the same result once. A shot whose rows all come again after its state
    is gone is told by the list of finished ones and left alone.
    """
    spark = frame_rows.sparkSession
    landing, done, state = f"{folder}/landing", f"{folder}/done", f"{folder}/state"
    trigger = trigger or {"availableNow": True}
    land = frame_rows.writeStream.format("parquet").partitionBy("shot").option("path", landing).option(
        "checkpointLocation", f"{state}/landing").trigger(**trigger).start()
    if "availableNow" in trigger or "once" in trigger:
        land.awaitTermination()

    def run(batch, number):
        ready = save(pending(batch.select("shot").distinct(), _read_done(spark, done).where(F.col("batch") < number)))
        ends = ready.agg(F.min("shot").alias("lo"), F.max("shot").alias("hi")).first()
        if ends.lo is not None:
            landed = spark.read.schema(frame_rows.schema).parquet(landing).where(F.col("shot").between(ends.lo, ends.hi))
            rows = attach(landed.join(ready, "shot", "left_semi"), expected.select("shot", "n_frames", "height"), ["shot"])
            rows = rows.where((F.col("frame") < F.col("n_frames")) & (F.col("y") < F.col("height")) & (F.least("frame", "y") >= 0))
            process(rows.select(frame_rows.columns).dropDuplicates(["shot", "frame", "y"])).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        ready.write.mode("overwrite").parquet(f"{done}/batch={number}")

    keys = spark.readStream.schema(frame_rows.schema).parquet(landing).select("shot", "frame", "y")
    shots = completeness.complete_shots(keys, expected, keep_ms)
    return shots.writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/shots").trigger(**trigger).start()


def _read_done(spark, path):
    """Shots finished by earlier batches; empty before the first batch."""
    empty = spark.createDataFrame([], "shot long, batch long")
    empty.limit(0).select("shot").write.mode("ignore").parquet(f"{path}/batch=-1")
    return spark.read.schema("shot long, batch long").parquet(path)


def results(spark, folder, schema):
    """Everything processed so far."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/results/batch=-1")
    return spark.read.schema(schema).parquet(f"{folder}/results").drop("batch")
