"""Saved tables, size-checked broadcasts and components shared by the operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectralake.storage import save

# A table is broadcast only when its saved rows times the bytes of one stay below this.
BROADCAST_BYTES = 64 << 20


def bounded(df, row_bytes):
    """Mark a *saved* table for broadcast if its counted rows are small enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def free_name(df, name):
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sampled(docs, ids, each=2, characters=1 << 12):
    """Runs of the texts of ``docs`` at the few ``ids``, bounded before they are collected.

    Of rows that share an id ``each`` at most, by hash. A text of up to ``characters`` is
    taken whole; of a longer one a run of that length that begins anywhere in it, by hash,
    without the words that its ends cut.
    """
    keys = ids.columns
    rows = docs.where("text is not null").select(*keys, "text", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    rows = rows.withColumn("at", F.pmod("h", F.greatest(F.col("n") - characters, F.lit(0)) + 1))
    run = F.substr("text", F.col("at").cast("int") + 1, F.lit(characters))
    run = F.when(F.col("at") > 0, F.regexp_replace(run, r"^\S+\s", "")).otherwise(run)
    run = F.when(F.col("at") + characters < F.col("n"), F.regexp_replace(run, r"\s\S+$", "")).otherwise(run)
    rows = rows.select(*keys, run.alias("text"), "h").join(F.broadcast(ids), keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "text"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= each).drop("nth", "h")


def sized(df, rows, each=200_000):
    """``df`` in as many partitions as its counted rows ask for, without a shuffle of its own."""
    return df.coalesce(max(1, -(-rows // each)))


def components(links, a="a", b="b"):
    """(vertex, root) of every vertex that occurs in ``links``; roots are vertices.

    Each round every vertex joins the neighbour of smallest hash, and the links move to
    the joined vertices, which at least halves long chains in the mean. All tables stay
    in Spark; each round is written, so its lineage is one scan. Loops are ignored.
    """
    links = save(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    known, seed = None, 0
    while True:
        rows = links.count()
        both = links.union(links.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        step = both.groupBy(F.col("a").alias("from")).agg(F.min(rank("b")).alias("best"), F.min(rank("a")).alias("own"))
        step = save(sized(step.select("from", F.least("best", "own")["v"].alias("to")), 2 * rows))
        small = bounded(step, 64)
        if known is None:
            known = step.select(F.col("from").alias("vertex"), F.col("to").alias("root"))
        else:
            known = save(known.join(small, known["root"] == small["from"], "left").select(
                "vertex", F.coalesce("to", "root").alias("root")))
        if not rows:
            return known
        moved = links.join(small.select(F.col("from").alias("a"), F.col("to").alias("a2")), "a").join(
            small.select(F.col("from").alias("b"), F.col("to").alias("b2")), "b")
        moved = moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b")
        links = save(sized(moved.distinct(), rows))
        seed += 1
        if links.isEmpty():
            return known
