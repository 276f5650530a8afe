"""Parquet stores laid out in hash buckets, so that joins and groupings on their keys need no exchange.

The rows of a bucket are in one file, sorted. Which columns make the buckets is not in
Parquet files, so a store has a small table beside its files that says so, and opening a
store declares it to the session's catalog. Buckets are by shot and frame: a shot with a
third of all frames is spread over all of them.
"""

import hashlib
import uuid

from pyspark.sql import functions as F

from spectralake.storage import shared_dir

KEYS = ("shot", "frame")
LAYOUT = "_layout"


def table_name(path):
    """Name of the store at ``path`` in the catalog."""
    return "store_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _declared(spark, path, schema, keys, order, buckets):
    """The store as a table of the session's catalog."""
    name = table_name(path)
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    location = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create table if not exists {name} ({schema}) using parquet clustered by ({quoted(keys)}) "
              f"sorted by ({quoted(order)}) into {buckets} buckets location '{location}'")
    return spark.table(name)


def _written(df, path, keys, order, buckets):
    spark = df.sparkSession
    buckets = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    order = (*keys, *order)
    table = _declared(spark, path, schema, keys, order, buckets)
    df.repartition(buckets, *keys).select(table.columns).write.insertInto(table_name(path))
    return schema, order, buckets


def write_store(df, path, keys=KEYS, order=(), buckets=None):
    """Write ``df`` as a new store at ``path`` and open it; ``order`` sorts rows within equal keys.

    ``buckets`` is the number of tasks that read it back: by default that of shuffles. What is
    already dealt out by the same keys and number is not moved again.
    """
    spark = df.sparkSession
    schema, order, buckets = _written(df, path, keys, order, buckets)
    layout = spark.range(1).select(F.lit(schema).alias("schema"), F.array(*map(F.lit, keys)).alias("keys"),
                                   F.array(*map(F.lit, order)).alias("order"), F.lit(buckets).alias("buckets"))
    layout.coalesce(1).write.json(f"{path}/{LAYOUT}")
    return spark.table(table_name(path))


def open_store(spark, path):
    """The store at ``path``, in any session."""
    row = spark.read.json(f"{path}/{LAYOUT}").first()
    return _declared(spark, path, row["schema"], row["keys"], row["order"], row["buckets"])


def save_store(df, keys=KEYS, order=(), buckets=None):
    """As ``storage.save``, in buckets; for this session."""
    path = f"{shared_dir(df.sparkSession)}/store-{uuid.uuid4().hex}"
    _written(df, path, keys, order, buckets)
    return df.sparkSession.table(table_name(path))
