"""Text outputs per shot, as rows of lines that Spark writes in parallel.

A line table is ``(shot, part, line, text)``: header lines are part 0, data part 1.
"""

from pyspark.sql import functions as F

from spectralake.operators.absolute import UNITS
from spectralake.sources import files
from spectralake.sources.shots import shot_number


def write_lines(lines, path):
    """Write one folder per shot; its files in name order hold the lines in order.

    Range partitioning splits a hot shot over several files instead of one task.
    """
    (lines.repartitionByRange("shot", "part", "line").sortWithinPartitions("shot", "part", "line")
     .select("shot", "text").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("shot").text(path))


def pattern_lines(pattern):
    """Order pattern as text: a line per column, orders side by side.

    The field number is the order's number, so every order up to the set's highest has a
    field in every line; one that is missing, or has no row there, is ``nan``.
    """
    highest = pattern.groupBy("cal_id").agg(F.max("ord").alias("top"))
    found = F.map_from_entries(F.collect_list(F.struct("ord", F.col("yc").cast("string").alias("yc"))))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("top")), lambda o: F.coalesce(F.col("found")[o], F.lit("nan")))
    return pattern.groupBy("cal_id", "x").agg(found.alias("found")).join(highest, "cal_id").select(
        F.col("cal_id").alias("shot"), F.lit(1).alias("part"), F.col("x").alias("line"), F.array_join(cells, " ").alias("text"))


def _number(pattern, c):
    return F.when(c.isNull(), F.lit("nan")).otherwise(F.format_string(pattern, c))


def _header(rows, templates):
    """Header lines from format strings over columns of ``rows``, one row per shot."""
    lines = F.array(*[F.format_string(t, *cols) if cols else F.lit(t) for t, cols in templates])
    return rows.select("shot", F.lit(0).alias("part"), F.posexplode(lines).alias("line", "text")).withColumn(
        "line", F.col("line").cast("long"))


def spectra_lines(spectra, shots, unit, name, date):
    """Spectra as text: wavelength, then one column per frame in the chosen unit.

    ``spectra`` is ``(shot, frame, pos, wl, <unit>)``. A line carries the shot's
    frames, which is the format; lines are built in parallel, and a frame that is missing
    is ``nan`` in its place. The header's size field is the number of frames.
    ``write_spectra`` is the output for large shots.
    """
    found = F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("long"), F.col(unit).cast("double"))))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1),
                        lambda i: _number("%.6e", F.col("found")[i]))
    packed = spectra.groupBy("shot", "pos", "wl").agg(found.alias("found"))
    data = packed.join(shots.select("shot", "n_frames"), "shot").withColumn("cells", cells).select(
        "shot", F.lit(1).alias("part"), F.col("pos").alias("line"),
        F.concat_ws(", ", F.array(F.format_string("%.6f", "wl")), "cells").alias("text"))
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1),
                          lambda i: F.concat(F.lit("'"), i.cast("string"), F.lit("'")))
    quoted = shots.select(
        "shot", F.col("n_frames").cast("string").alias("n"), F.array_join(numbers, ",").alias("names"),
        F.array_join(F.array_repeat(F.lit(f"{UNITS[unit]}"), F.col("n_frames").cast("int")), "','").alias("units"),
        F.col("shot").cast("string").alias("s"), F.col("cycle_s").cast("string").alias("cycle"),
        F.col("exposure_s").cast("string").alias("exposure"), F.col("trig_delay_s").cast("string").alias("delay"))
    header = _header(quoted, [
        ("# [Parameters]", []), (f"# Name = '{name}'", []), ("# ShotNo = %s", ["s"]), (f"# Date = '{date}'", []),
        ("#", []), ("# DimNo = 1", []), ("# DimName = 'wavelength'", []), ("# DimSize = %s", ["n"]),
        ("# DimUnits = 'nm'", []), ("#", []), ("# ValNo = %s", ["n"]), ("# ValName = %s", ["names"]),
        ("# ValUnit = '%s'", ["units"]), ("#", []), ("# [Comments]", []),
        ("# time = %s + frameNo*%s (s)", ["delay", "cycle"]), ("# exposure = %s (s)", ["exposure"]),
        ("#", []), ("# [Data]", [])])
    return header.unionByName(data)


def intensity_lines(table, bands, shots, name, date, comments=()):
    """Intensity table as text: time, then one column per band; frame 0 is not in it."""
    cell = lambda b: _number("%.6e", F.col(f"`{b}`").cast("double"))
    data = table.select(
        "shot", F.lit(1).alias("part"), F.col("frame").alias("line"),
        F.concat_ws(", ", F.format_string("%.5f", "time_s"), *[cell(b) for b in bands]).alias("text"))
    sizes = table.groupBy("shot").agg(F.count("*").cast("string").alias("n"))
    rows = sizes.join(shots, "shot").select(
        "shot", "n", F.col("shot").cast("string").alias("s"), F.col("cycle_s").cast("string").alias("cycle"),
        F.col("trig_delay_s").cast("string").alias("delay"))
    names = ",".join(f"'{b}'" for b in bands)
    units = ",".join(["'W/m^2'"] * len(bands))
    header = _header(rows, [
        ("# [Parameters]", []), (f"# Name = '{name}'", []), ("# ShotNo = %s", ["s"]), (f"# Date = '{date}'", []),
        ("#", []), ("# DimNo = 1", []), ("# DimName = 'Time'", []), ("# DimSize = %s", ["n"]),
        ("# DimUnit = 's'", []), ("#", []), (f"# ValNo = {len(bands)}", []), (f"# ValName = {names}", []),
        (f"# ValUnit = {units}", []), ("#", []), ("# [Comments]", []), *[(f"# {c}", []) for c in comments],
        ("# time = %s + frameNo*%s (s)", ["delay", "cycle"]), ("#", []), ("# [Data]", [])])
    return header.unionByName(data)


def write_shot_files(lines, path, suffix="txt"):
    """Write ``(shot, part, line, text)`` as one text file per shot, its lines in order.

    Files appear when the whole job is done; those of lost attempts never do.
    """
    files.write_files(lines.select(
        F.format_string(f"%d.{suffix}", "shot").alias("file"), F.struct("part", "line").alias("part"),
        F.encode(F.concat("text", F.lit("\n")), "UTF-8").alias("data")), path)


def read_shot_files(spark, path, suffix="txt"):
    """Lines ``(shot, number, text)`` of the text files of shots; a file is one value."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{suffix}").select(
        shot_number(F.col("_metadata.file_path")).alias("shot"), F.split(F.rtrim("value", F.lit("\n")), "\n").alias("lines"))
    return whole.select("shot", F.posexplode("lines").alias("number", "text")).withColumn("number", F.col("number").cast("long"))


def write_spectra(spectra, path):
    """Spectra as Parquet, one folder per shot, a frame's pixels together."""
    (spectra.repartitionByRange("shot", "frame").sortWithinPartitions("shot", "frame", "seq")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("shot").parquet(path))


def written_shots(spark, path, schema):
    """Shots that already have output, from the folder names."""
    return spark.read.schema(schema).parquet(path).select("shot").distinct()


