"""Saved intermediate tables and size-checked joins."""

import tempfile
import uuid

from pyspark.sql import functions as F

# What a broadcast may hold; a fixed-width row of the tables attached here is below 200 bytes.
BROADCAST_BYTES = 100_000_000
ROW_BYTES = 200


def shared_dir(spark):
    """Folder for saved tables: what ``spark.checkpoint.dir`` names.

    Where it is unset a local session, as in tests, gets a scratch folder; on a cluster,
    executors would not see each other's files in one, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spectralake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def save(df):
    """Write ``df`` to the shared folder and return it as a table scan.

    The lineage ends at files every executor can read, so losing executors
    later never recomputes what stands behind this table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(fact, dim, on, how="inner", max_rows=None, row_bytes=ROW_BYTES):
    """Join a saved dimension table to a fact table.

    ``dim`` is broadcast only when its counted rows, taken as ``row_bytes`` each, stay
    below ``BROADCAST_BYTES``; a larger one is joined by shuffle, where AQE splits hot
    keys. Counting stops at the limit, and on a saved table it reads no columns.
    The shuffle is asked for: Spark goes by the size of files, and those of a saved table
    may be a hundredth of its rows in memory.
    """
    max_rows = max_rows or BROADCAST_BYTES // row_bytes
    small = dim.select(F.lit(1)).limit(max_rows + 1).count() <= max_rows
    return fact.join(F.broadcast(dim) if small else dim.hint("merge"), on, how)


def dealt(df, *keys):
    """Partition by ``keys`` before rows are unfolded to many.

    A small table is one file and one task, however many rows each of its rows becomes,
    and AQE would merge its few bytes again; so the number of partitions is that of shuffles.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df, *keys):
    """Partition by ``keys`` for a grouped solver job.

    Solvers are bound by computing, not by bytes, so the number of partitions is
    fixed and four times the usual: AQE would merge small ones into a few slow
    tasks. The grouping that follows on the same keys needs no further shuffle.
    """
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
