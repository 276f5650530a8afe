"""Approximate nearest neighbours by several shifted Hilbert curves.

Nearness is the inner product in double precision. Each curve orders all vectors by the
Hilbert key of a projection and shift of its own; Spark range-partitions the keys and
places are counted through, so every vector has a place on every curve. A query meets the
vectors within ``reach`` places of it on each curve; the finds of all curves merge, and
scores are computed from the original vectors.

``reach`` is not a guess: for a bounded sample of queries the true neighbours are found by
one pass over all vectors, their places on the curves are looked up, and the smallest
reach that covers the share ``RECALL`` of them is taken, raised by two standard errors of
such a share among so many queries: few queries tell little, so the share of a small
sample is 1. On clustered vectors that is a
small part of a curve; on vectors without any structure no ordering helps, and reach
becomes a large part of it (the search stays whole, and its work grows accordingly).

Equal vectors are one class: only the class is placed and compared, its ``k`` + 1 smallest
ids stand for it. A curve is cut in blocks of ``BLOCK`` places; a task holds one block and
streams the queries that reach it, each of which is held against the places within its
reach only. Finds are merged in two steps, ``MERGES`` lists a query in the second, so no
list of finds grows with the table.

Vectors that are null, zero, of another length than most, or hold nulls or numbers that
are not finite take no part, nor do rows without an id. Rows that repeat an id with the
same vector are one; a query never finds its own id. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from spectralake.llm.tables import bounded
from spectralake.storage import save

K = 20
CURVES = 4
AXES, BITS = 8, 7       # of a curve's grid
BLOCK = 4096
MERGES = 64
SAMPLE = 128            # queries whose true neighbours set the reach
RECALL = 0.94


def classes(rows, k=K):
    """(class_id, vector, members) of each distinct usable vector of (vec_id, embedding) rows; saved."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (sizes["n"] if sizes else 0))
    # the limit by class works before the shuffle: a hot vector sends k + 1 rows a task
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.select("v", "vec_id").withColumn("n", nth).where(F.col("n") <= k + 1)
    return save(few.groupBy("v").agg(F.array_distinct(F.array_sort(F.collect_list("vec_id"))).alias("members")).select(
        F.col("members")[0].alias("class_id"), F.col("v").alias("vector"), "members"))


def hilbert(grid, bits):
    """Hilbert keys of integer points (n, axes), after Skilling's transposed form."""
    x = grid.T.astype(np.int64).copy()
    axes = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(axes):
            hit = (x[i] & bit) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _axes(dims, curve):
    """Orthogonal axes and shifts of a curve; the same for every run."""
    random = np.random.default_rng(1000 + curve)
    axes = min(AXES, dims)
    return np.linalg.qr(random.normal(size=(dims, axes)))[0], random.random(axes)


def placed(points, dims, curves=CURVES):
    """(curve, place, class_id, vector): the place of every class on every curve; saved, with the number of classes."""
    spark = points.sparkSession
    moments = points.select(F.transform("vector", lambda x: x).alias("v")).agg(*[
        f(F.col("v")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] for i in range(dims)])
    scale = float(np.sqrt(np.mean([moments[f"s{i}"] ** 2 for i in range(dims)]))) or 1.0

    def keys(batches):
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            for curve in range(curves):
                axes, shift = _axes(dims, curve)
                cells = ((vectors - mean) @ axes / scale + 3 + shift) * ((1 << BITS) / 7)
                grid = np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(batch), curve, np.int32)), pa.array(hilbert(grid, BITS)), batch.column("class_id"), batch.column("vector")],
                    ["curve", "key", "class_id", "vector"])

    def count(batches):
        seen = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            curve = batch.column("curve").to_numpy()
            local = np.zeros(len(curve), np.int64)
            for c in np.unique(curve):
                mine = curve == c
                local[mine] = seen.get(c, 0) + np.arange(mine.sum())
                seen[c] = seen.get(c, 0) + int(mine.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("curve"), pa.array(np.full(len(curve), part, np.int32)), pa.array(local), batch.column("class_id"), batch.column("vector")],
                ["curve", "part", "local", "class_id", "vector"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = points.select("class_id", "vector").mapInArrow(keys, "curve int, key long, class_id long, vector array<double>")
    ordered = keyed.repartitionByRange(parts, "curve", "key", "class_id").sortWithinPartitions("curve", "key", "class_id")
    local = save(ordered.mapInArrow(count, "curve int, part int, local long, class_id long, vector array<double>"))
    # one row for each partition and curve
    starts = local.groupBy("curve", "part").count().withColumn("start", F.coalesce(F.sum("count").over(
        Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return local.join(bounded(save(starts), 64), ["curve", "part"]).select(
        "curve", (F.col("start") + F.col("local")).alias("place"), "class_id", "vector")


def _best(queries, vectors, ids, k, within=None):
    """Score and id of the best ``k`` + 1 of ``vectors`` for each query, of those that ``within`` (query, vector) allows.

    Equal pairs score equally everywhere.
    """
    rough = queries @ vectors.T
    if within is not None:
        rough[~within] = -np.inf
    most = min(k + 1, len(ids))
    last = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
    # all that rounding could put among the best, so ties at the cut are settled by id
    error = 8 * vectors.shape[1] * np.finfo(float).eps * np.sqrt((queries ** 2).sum(1) * (vectors ** 2).sum(1).max())
    for q, near, least in zip(queries, rough, last - error):
        row = np.flatnonzero(~(near < least) & (near > -np.inf))
        score = (vectors[row] * q).sum(1)
        order = np.lexsort((ids[row], -score))[:k + 1]
        yield score[order], ids[row][order]


def _pairs(found):
    kind = pa.list_(pa.struct([("less", pa.float64()), ("class_id", pa.int64())]))
    return pa.array([[{"less": -s, "class_id": i} for s, i in zip(score.tolist(), ids.tolist())] for score, ids in found], kind)


def exact(points, queries, k=K):
    """(query, best): the true ``k`` + 1 best classes of a bounded array of queries [(id, vector)], one pass."""
    names, wanted = [q for q, _ in queries], np.array([v for _, v in queries])

    def run(batches):
        for batch in batches:
            if len(batch):
                found = _best(wanted, _matrix(batch.column("vector")), batch.column("class_id").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _pairs(found)], ["query", "best"])

    return _merged(points.select("class_id", "vector").mapInArrow(run, "query long, best array<struct<less:double,class_id:bigint>>"), k)


def _merged(found, k):
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k + 1).alias("best")
    if "salt" in found.columns:
        found = found.groupBy("query", "salt").agg(best)
    return found.groupBy("query").agg(best)


def reach_of(places, points, queries, total, k=K, recall=RECALL, sample=SAMPLE):
    """The smallest reach that covers the wanted share of the sample's true neighbours; ``k`` places at least."""
    picked = points.join(queries.orderBy(F.xxhash64("class_id"), "class_id").limit(sample), "class_id").select("class_id", "vector").collect()
    picked = [(r["class_id"], r["vector"]) for r in picked]
    if not picked:
        return total
    truth = {r["query"]: [b["class_id"] for b in r["best"] if b["class_id"] != r["query"]][:k] for r in exact(points, picked, k).collect()}
    wanted = sorted({c for q, near in truth.items() for c in (q, *near)})
    ids = points.sparkSession.createDataFrame([(c,) for c in wanted], "class_id long")
    at = {}
    for r in places.select("curve", "place", "class_id").join(F.broadcast(ids), "class_id").collect():
        at.setdefault(r["class_id"], {})[r["curve"]] = r["place"]
    gaps = np.array([min(abs(at[q][c] - at[n][c]) for c in at[q]) for q, near in truth.items() for n in near])
    share = min(1.0, recall + 2 * np.sqrt(recall * (1 - recall) / len(truth)))
    return int(min(total, max(k, np.quantile(gaps, share, method="higher")) + 1)) if len(gaps) else total


def search(rows, queries, k=K, curves=CURVES, recall=RECALL):
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query.

    ``rows`` (vec_id, embedding) is searched; ``queries`` is a condition on ``vec_id``
    that picks the rows to search for.
    """
    points = classes(rows, k)
    first = points.select(F.size("vector").alias("n")).first()
    asked = rows.where(queries).where("vec_id is not null")
    total = points.count()
    known = points.select("class_id", F.col("vector").alias("v"))
    asked = save(asked.select(F.col("vec_id").cast("long").alias("query_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
                 .distinct().join(known, "v").select("query_id", "class_id"))
    wanted = save(asked.select("class_id").distinct())
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not total or first is None:
        return empty
    places = placed(points, first["n"], curves)
    reach = reach_of(places, points, wanted, total, k, recall)
    held = places.select("curve", F.floor(F.col("place") / BLOCK).alias("block"), F.lit(0).alias("kind"), "place", "class_id", "vector")
    low, high = F.greatest(F.col("place") - reach, F.lit(0)), F.least(F.col("place") + reach, F.lit(total - 1))
    moving = places.join(bounded(wanted, 64), "class_id", "left_semi").select(
        "curve", F.explode(F.sequence(F.floor(low / BLOCK), F.floor(high / BLOCK))).alias("block"), F.lit(1).alias("kind"), "place", "class_id", "vector")

    def run(batches):
        here, ids, vectors, at_places, ready = None, [], [], [], None
        for batch in batches:
            curve, block, kind = (batch.column(c).to_numpy() for c in ("curve", "block", "kind"))
            edge = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edge], [*edge, len(batch)]):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), (curve[a], block[a])
                if key != here:
                    here, ids, vectors, at_places, ready = key, [], [], [], None
                if kind[a] == 0:
                    ids.append(part.column("class_id").to_numpy())
                    vectors.append(_matrix(part.column("vector")))
                    at_places.append(part.column("place").to_numpy())
                elif ids:
                    ready = ready or (np.concatenate(vectors), np.concatenate(ids), np.concatenate(at_places))
                    for at in range(0, len(part), 512):
                        some = part.slice(at, 512)
                        within = np.abs(some.column("place").to_numpy()[:, None] - ready[2]) <= reach
                        found = _best(_matrix(some.column("vector")), *ready[:2], k, within)
                        salt = pa.array(np.full(len(some), block[a] % MERGES, np.int32))
                        yield pa.RecordBatch.from_arrays([some.column("class_id"), salt, _pairs(found)], ["query", "salt", "best"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = held.union(moving).repartition(parts, "curve", "block").sortWithinPartitions("curve", "block", "kind", "class_id")
    found = _merged(groups.mapInArrow(run, "query long, salt int, best array<struct<less:double,class_id:bigint>>"), k)
    members = points.select("class_id", "members")
    listed = found.select("query", F.explode("best").alias("b")).select("query", "b.less", F.col("b.class_id").alias("class_id"))
    listed = listed.join(bounded(members, 512), "class_id").groupBy("query").agg(F.flatten(F.collect_list(F.transform(
        "members", lambda m: F.struct(F.col("less").alias("less"), m.alias("vec_id"))))).alias("near"))
    result = asked.join(listed, asked["class_id"] == listed["query"]).select("query_id", F.posexplode(F.slice(F.array_sort(F.filter(
        F.array_distinct("near"), lambda x: x["vec_id"] != F.col("query_id"))), 1, k)).alias("rank", "near"))
    return result.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "near.vec_id", (-F.col("near.less")).alias("score"))
