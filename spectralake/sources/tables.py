"""Calibration text tables: line lists, lamp irradiance, order patterns."""

from pyspark.sql import functions as F


def _fields(lines):
    """Fields of each line that holds more than a comment."""
    bare = F.trim(F.translate(F.substring_index("value", "#", 1), "\t\r", "  "))
    return lines.withColumn("value", bare).where(F.length("value") > 0).withColumn(
        "field", F.split("value", " +")).drop("value")


def parse_line_list(lines):
    """Calibration lines from text rows; other columns (such as ``cal_id``) are kept.

    Columns are order, from, to, centre and wavelength, then an optional species.
    The window ``from..to`` is carried but never filters: a centre may lie outside.
    A field that is no number is NULL; fits skip it.
    """
    f = lambda i: F.get("field", F.lit(i))
    rows = _fields(lines)
    keep = [c for c in rows.columns if c != "field"]
    return rows.select(
        *keep,
        f(0).try_cast("double").cast("long").alias("ord"),
        f(1).try_cast("double").alias("px_from"), f(2).try_cast("double").alias("px_to"),
        f(3).try_cast("double").alias("px"), f(4).try_cast("double").alias("wl"),
        f(5).alias("species"),
    )


def read_line_list(spark, path, cal_id):
    return parse_line_list(spark.read.text(path).withColumn("cal_id", F.lit(cal_id).cast("long")))


def parse_irradiance(lines):
    """Lamp irradiance knots ``um, mw`` from text rows."""
    rows = _fields(lines)
    keep = [c for c in rows.columns if c != "field"]
    return rows.select(
        *keep,
        F.get("field", F.lit(0)).try_cast("double").alias("um"),
        F.get("field", F.lit(1)).try_cast("double").alias("mw"),
    )


def read_irradiance(spark, path, cal_id):
    return parse_irradiance(spark.read.text(path).withColumn("cal_id", F.lit(cal_id).cast("long")))


def parse_pattern(texts):
    """Row centres from whole pattern texts: line number is x, field number the order.

    A field that is no number is a missing centre: NULL.
    """
    lines = (
        texts.withColumn("line", F.filter(F.split("value", "\r?\n"), lambda v: F.trim(v) != ""))
        .drop("value")
    )
    keep = [c for c in lines.columns if c != "line"]
    fields = lines.select(*keep, F.posexplode("line").alias("x", "text"))
    cells = fields.select(
        *keep, "x", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("ord", "yc"))
    return cells.select(*keep, F.col("ord").cast("long").alias("ord"), F.col("x").cast("long").alias("x"),
                        F.when(F.lower("yc") != "nan", F.col("yc").try_cast("double")).cast("long").alias("yc"))


def read_pattern(spark, path, cal_id):
    texts = spark.read.text(path, wholetext=True)
    return parse_pattern(texts.withColumn("cal_id", F.lit(cal_id).cast("long")))


def calibrations(spark, rows):
    """Registry of calibration sets, one row per campaign.

    ``rows`` are ``(cal_id, camera, orders, wavelength, sphere, dark, irradiance,
    dv, dim_w, dim_o)``: file names, half width of an order and sensor size.
    """
    return spark.createDataFrame(rows, (
        "cal_id long, camera string, orders string, wavelength string, sphere string, "
        "dark string, irradiance string, dv long, dim_w long, dim_o long"))


def resolve_calibrations(registry, folder):
    """Unpivot the registry into one row per calibration file, with its path."""
    roles = ["orders", "wavelength", "sphere", "dark", "irradiance"]
    pairs = ", ".join(f"'{r}', {r}" for r in roles)
    return registry.selectExpr(
        "cal_id", "camera", f"stack({len(roles)}, {pairs}) as (role, file)"
    ).withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "file"))
