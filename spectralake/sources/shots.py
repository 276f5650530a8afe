"""Shot files: listing, frame scan and metadata."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_ROWS = "shot long, frame long, y long, row array<double>"

INFO = T.StructType([
    T.StructField("NumberOfFrames", T.LongType()),
    T.StructField("ExposureTime", T.DoubleType()),
    T.StructField("CycleTime", T.DoubleType()),
    T.StructField("xbin", T.LongType()),
    T.StructField("ybin", T.LongType()),
    T.StructField("DetectorDimensions", T.ArrayType(T.LongType())),
    T.StructField("DetectorTemperature", T.DoubleType()),
])


def list_files(spark, folder, glob="*.SIF"):
    """Recursive listing of image files; file contents are never read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(folder)
        .select("path", "modificationTime")
    )


def shot_number(path):
    """Integer before the first underscore of the file name, NULL when it is none."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.substring_index(stem, "_", 1).try_cast("long")


def index_shots(files):
    """One path per shot number; of copies in several folders the newest wins.

    Files without a number are no shots: ``unnumbered`` lists them.
    """
    newest = F.struct("modificationTime", "path")
    return (
        files.withColumn("shot", shot_number(F.col("path"))).where("shot is not null")
        .groupBy("shot").agg(F.max(newest).alias("newest"))
        .select("shot", F.col("newest.path").alias("path"))
    )


def unnumbered(files):
    """Files whose name begins with no shot number."""
    return files.where(shot_number(F.col("path")).isNull())


def shot_range(shots):
    """First and last shot number."""
    return shots.agg(F.min("shot").alias("first_shot"), F.max("shot").alias("last_shot"))


def scan_frames(spark, folder, decoder, glob="*.SIF"):
    """Decode image files into ``FRAME_ROWS``.

    ``decoder(path, content)`` is supplied by the caller for the camera's format
    and yields ``(shot, frame, y, row)``. Rows leave the task in batches, so a
    file is held once and never as a frame table.
    """
    def decode(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for row in decoder(path, content):
                    rows.append(row)
                    if len(rows) == 1024:
                        yield pd.DataFrame(rows, columns=["shot", "frame", "y", "row"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["shot", "frame", "y", "row"])

    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(folder).select("path", "content")
    )
    return files.mapInPandas(decode, FRAME_ROWS)


def write_frames(frame_rows, path):
    """Canonical frame store: Parquet, one folder per shot, rows of a frame together.

    Range partitioning splits a hot shot by frame over many tasks.
    """
    (frame_rows.repartitionByRange("shot", "frame", "y").sortWithinPartitions("shot", "frame", "y")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shot").parquet(path))


def read_frames(spark, path):
    """Scan of the canonical frame store; ``shot`` filters prune folders."""
    return spark.read.schema(FRAME_ROWS).parquet(path)


def pixels(frame_rows):
    """Long view ``(shot, frame, y, x, counts)`` of the image rows."""
    return frame_rows.select("shot", "frame", "y", F.posexplode("row").alias("x", "counts")).withColumn(
        "x", F.col("x").cast("long"))


def shots_meta(infos, exposure=None):
    """Typed shot metadata from ``(shot, path, camera, info)`` with ``info`` as JSON text.

    ``exposure`` stands in where the files of a camera carry none.
    """
    i = F.from_json("info", INFO).alias("i")
    return infos.select("shot", "path", "camera", i).select(
        "shot", "path", "camera",
        F.col("i.NumberOfFrames").alias("n_frames"),
        F.coalesce("i.ExposureTime", F.lit(exposure).cast("double")).alias("exposure_s"),
        F.col("i.CycleTime").alias("cycle_s"),
        F.coalesce("i.xbin", F.lit(1)).alias("xbin"),
        F.coalesce("i.ybin", F.lit(1)).alias("ybin"),
        F.get("i.DetectorDimensions", F.lit(0)).alias("dim_w"),
        F.get("i.DetectorDimensions", F.lit(1)).alias("dim_o"),
        F.col("i.DetectorTemperature").alias("temp_c"),
    )
