"""Session settings the operators are tuned for."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# AQE re-plans joins from measured shuffle sizes and splits hot partitions;
# the packed partition size keeps a scan task well inside executor memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app="spectralake", master=None, **extra):
    """Create a session with ``SETTINGS``; ``extra`` keys override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark):
    """Send the package to the Python workers, once per application.

    Not needed where it is installed on the executors or given by ``--py-files``.
    """
    if spark.conf.get("spark.spectralake.shipped", None) == spark.sparkContext.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spectralake-"), "spectralake.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("spectralake", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(path)
    spark.conf.set("spark.spectralake.shipped", spark.sparkContext.applicationId)
