"""Background frames: quiet frames, their longest run, subtraction."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spectralake.storage import attach

# Runs are found inside blocks of this many frames and joined at block ends,
# so a shot of any length is spread over tasks.
BLOCK = 4096


def quiet_frames(spectra, k=5.0):
    """Frames without a point above mean + k population standard deviations."""
    return spectra.groupBy("shot", "frame").agg(
        F.max("counts").alias("top"), F.avg("counts").alias("mean"), F.stddev_pop("counts").alias("sd")
    ).withColumn("quiet", F.col("top") <= F.col("mean") + F.lit(float(k)) * F.col("sd"))


def longest_run(quiet, block=BLOCK):
    """Longest run of consecutive quiet frames of each shot, the first of equals.

    Runs inside a block are final; only those that touch a block's end, two a
    block at most, are joined across blocks.
    """
    line = W.partitionBy("shot", "block").orderBy("frame")
    runs = (
        quiet.where("quiet").select("shot", "frame", F.floor(F.col("frame") / block).alias("block"))
        .withColumn("island", F.col("frame") - F.row_number().over(line))
        .groupBy("shot", "block", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
        .select("shot", "first", "last")
    )
    at_end = (F.col("first") % block == 0) | (F.col("last") % block == block - 1)
    ends = W.partitionBy("shot").orderBy("first")
    joined = (
        runs.where(at_end)
        .withColumn("starts", F.coalesce((F.col("first") - F.lag("last").over(ends) != 1).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("starts").over(ends))
        .groupBy("shot", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
    )
    best = F.max(F.struct((F.col("last") - F.col("first") + 1).alias("n"), (-F.col("first")).alias("from")))
    return (
        runs.where(~at_end).unionByName(joined).groupBy("shot").agg(best.alias("best"))
        .select("shot", (-F.col("best.from")).alias("run_first"),
                (-F.col("best.from") + F.col("best.n") - 1).alias("run_last"), F.col("best.n").alias("run_n"))
    )


def subtract_background(spectra, runs, frame_counts, keys=("ord", "x")):
    """Subtract the mean of the background run from every frame.

    ``runs`` and ``frame_counts(shot, n_frames)`` are saved, one row per shot.
    Single-frame shots stay as they are. A shot without a quiet frame has no
    background: NULL counts and ``background`` false. The mean is a window over
    one pixel of one shot, so a hot shot is spread by pixel.
    """
    pixel = W.partitionBy("shot", *keys)
    shots = frame_counts.select("shot", "n_frames").join(runs, "shot", "left")
    in_run = F.col("frame").between(F.col("run_first"), F.col("run_last"))
    mean = F.avg(F.when(in_run, F.col("counts"))).over(pixel)
    single = F.col("n_frames") <= 1
    return (
        attach(spectra, shots, ["shot"])
        .withColumn("level", mean)
        .withColumn("counts", F.when(single, F.col("counts").cast("double")).otherwise(
            F.col("counts") - F.col("level")))
        .withColumn("background", single | F.col("run_n").isNotNull())
        .drop("level", "n_frames", "run_first", "run_last", "run_n")
    )


def background_summary(shots, runs):
    """Text ``[first..last] (n)`` of each shot, or ``None``."""
    text = F.format_string("[%d..%d] (%d)", "run_first", "run_last", "run_n")
    return shots.select("shot").join(runs, "shot", "left").select(
        "shot", F.when(F.col("run_n").isNotNull(), text).otherwise(F.lit("None")).alias("background"))
