"""Jaccard join of documents on word n-grams by a forest of signature trees.

Two texts link when the distinct word shingles of one and the other satisfy
``den * |intersection| >= num * |union|`` (80 of 100 unless told otherwise).

How it works, and why no link is lost:

1. *Subtrees.* Two linked sets differ in at most a quarter of the smaller one's
   shingles. Each set is cut into parts by hash; a part touched by no difference is the
   same in both, so both carry its key. A set gives the first ``n / 4 + 1`` of its keys
   in one fixed order, which is enough for two linked sets to share one (prefix
   argument). Sets too dense for that give single shingles as well. Pairs without a
   common key are thereby pruned by their maximum possible overlap before any
   comparison. Parts with more shingles that are rare come first in the order, those
   made only of shingles found in many documents last: that choice changes the work,
   never the result. A set gives up to ``SPARE`` keys more, and two linked sets share as
   many more. So two sets tied by few keys, as by a passage or by chance, are left alone
   where all their keys are in groups of up to ``PAIRED`` sets, whose pairs are counted;
   the sets of a larger group are all tied to its first one, the hub. Sets connected
   through ties form one subtree.
2. *Signature tree.* Within a subtree every leaf holds a set, every node the OR of its
   sets' bitmaps and their size range. A dual traversal visits pairs of nodes and prunes
   those whose sizes cannot match, whose common bits allow too little overlap, or whose
   sets are all connected already; surviving leaves are compared exactly.
3. *Hot subtrees* are cut by hash into blocks of ``FANOUT`` sets: first each block with
   itself and with block 0, then only the sets which that left outside the subtree's
   largest component, each with the sets tied to the same hub. A group of copies of any
   size is done after the first pass, which is linear in its size; a subtree of sets that
   are hardly alike costs as much as it has ties, not the square of its size.

Equal sets are one class from the start: within a task they are sent once, and keys go
by a hash of the set, so that copies in many tasks are one member of a key.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectralake.llm import text as T
from spectralake.llm.tables import BROADCAST_BYTES, bounded, components
from spectralake.storage import save

WIDTH = 5
NUM, DEN = 80, 100
FANOUT = 1024          # sets in a block of a hot subtree
LEAF = 16              # sets in a leaf of a tree
SLOTS = 1 << 22        # counters that tell common shingles (their flags are 512 kB)
SLOT_SHIFT = np.uint64(42)
SLOT_ROWS = 16
COMMON_LEAST = 16      # documents beyond the mean of a slot
KEYS_A_BUCKET = 100_000
SPARE = 8              # keys that a large set gives beyond those it must
PAIRED = 8             # sets of a key whose pairs are counted
PLAN_BYTES = 128       # a row of a plan in memory
SLICES = 16            # times at most that texts are read again to keep plans small
EMITTED = "bucket int, doc_id long, n long, a long, b long, keys binary, ids binary"
MATCHED = "doc_id long, n long, a long, b long, hub long"


def _sets(batch, width):
    """(ids, sets) of each block of a batch; ids may be null."""
    ids = batch.column("doc_id").cast(pa.int64())
    for lo, hi, data, offsets in T.blocks(batch.column("text")):
        words, doc, _, _ = T.word_hashes(data, offsets)
        hashes, doc = T.shingle_hashes(words, doc, hi - lo, width)
        yield ids.slice(lo, hi - lo), T.sets_of(hashes, doc, hi - lo)


def _identity(values):
    """128 bits that stand for a set."""
    return (int(np.bitwise_xor.reduce(T.mix(values + np.uint64(1)))) if len(values) else 0,
            int(np.add.reduce(T.mix(values ^ np.uint64(0xA5A5A5A5)))) if len(values) else 0)


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def common_slots(docs, width=WIDTH):
    """(flags of the hash slots that hold shingles of many documents, number of shingles).

    Every distinct shingle of every document is counted in one of ``SLOTS`` slots, a table
    of fixed size. A slot far above the mean holds a shingle of many documents; the rare
    ones that share its slot are taken for common, too, which does no harm.
    """
    def count(batches):
        counts = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for _, sets in _sets(batch, width):
                np.add.at(counts, (np.concatenate(sets) >> SLOT_SHIFT).astype(np.int64), 1)
        # 255 in one task is far above any mean; small numbers pack well
        packed = np.minimum(counts, 255).astype(np.uint8).reshape(SLOT_ROWS, -1)
        total = np.zeros(SLOT_ROWS, np.int64)
        total[0] = counts.sum(dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(SLOT_ROWS)), pa.array(total), pa.array([row.tobytes() for row in packed], pa.binary())],
            ["slice", "total", "counts"])

    def add(batches):
        sums, totals = {}, {}
        for batch in batches:
            for at, total, row in zip(*(c.to_pylist() for c in batch.columns)):
                sums[at] = sums.get(at, 0) + np.frombuffer(row, np.uint8).astype(np.int64)
                totals[at] = totals.get(at, 0) + total
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array(list(totals.values()), pa.int64()),
             pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in sums.values()], pa.binary())],
            ["slice", "total", "counts"])

    schema = "slice long, total long, counts binary"
    rows = docs.select("doc_id", "text").mapInArrow(count, schema).repartition(SLOT_ROWS, "slice").mapInArrow(add, schema).collect()
    counts = np.zeros((SLOT_ROWS, SLOTS // SLOT_ROWS), np.int64)
    for row in rows:
        counts[row["slice"]] = np.frombuffer(row["counts"], np.int32)
    mean = counts.mean()
    return np.packbits(counts.ravel() >= COMMON_LEAST + mean + 6 * math.sqrt(mean)), sum(r["total"] for r in rows)


def _ordered(keys, rare, most):
    """The first keys: those with most rare shingles, up to three, before the others, then by hash."""
    keys = (keys >> np.uint64(2)) | ((3 - np.minimum(rare, 3)).astype(np.uint64) << np.uint64(62))
    return np.sort(keys)[:most]


def keys_of(values, rare, slack):
    """(keys of one set, ``need``): two linked sets share at least the lesser ``need`` of both.

    ``slack`` is how much of the smaller set two linked sets may differ in.
    """
    n = len(values)
    level = n.bit_length() - 1
    levels = [(level, n)]
    if level and n <= (1 + slack) * (1 << level):
        levels.append((level - 1, (1 << level) - 1))  # only for sets below this level: the smaller ones
    result, need = [], min(SPARE, max(1, n >> 4))
    spare = need
    mixed = T.mix(values + np.uint64(7))
    for level, size in levels:
        differ = int(math.floor(slack * size + 1e-9))
        parts = max(1, (2 << level) // 3)
        part = mixed % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        keys = T.mix(np.add.reduceat(mixed[order], heads) + ranked[heads] * T.PLACES[3] + np.uint64(level))
        result.append(_ordered(keys, np.add.reduceat(rare[order].astype(np.int64), heads), differ + spare))
        need = max(1, min(need, len(heads) - differ))
        if len(heads) <= differ:
            result.append(_ordered(T.mix(mixed + T.PLACES[5]), rare.astype(np.int64), differ + 1))
    return np.unique(np.concatenate(result)), 1 << (need.bit_length() - 1)


def _emit(common, buckets, width, slack):
    def run(batches):
        seen, flags = set(), np.unpackbits(common)
        for batch in batches:
            ids_out, n_out, a_out, b_out = [], [], [], []
            parts = {}
            for ids, sets in _sets(batch, width):
                flat = np.concatenate(sets)
                rare = flags[(flat >> SLOT_SHIFT).astype(np.int64)] == 0
                at = 0
                for doc_id, values in zip(ids.to_pylist(), sets):
                    mine = rare[at:at + len(values)]
                    at += len(values)
                    a, b = _identity(values)
                    ids_out.append(doc_id)
                    n_out.append(len(values))
                    a_out.append(_signed(a))
                    b_out.append(_signed(b))
                    if not len(values) or doc_id is None or (a, b) in seen:
                        continue
                    seen.add((a, b))
                    keys, need = keys_of(values, mine, slack)
                    parts.setdefault(need, []).append((keys, np.full(len(keys), a_out[-1], np.int64)))
            n = len(ids_out)
            empty = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.abs(np.array(a_out, np.int64) % buckets).astype(np.int32)), pa.array(ids_out, pa.int64()),
                 pa.array(n_out, pa.int64()), pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), empty, empty],
                ["bucket", "doc_id", "n", "a", "b", "keys", "ids"])
            for need, found in parts.items():
                keys, owners = (np.concatenate(x) for x in zip(*found))
                bucket = T.mix(keys) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                keys, owners, bucket = keys[order], owners[order], bucket[order].astype(np.int32)
                heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(heads[1:], len(keys))
                none = pa.nulls(len(heads), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[heads]), none, pa.array(np.full(len(heads), need, np.int64)), none, none,
                     pa.array([keys[s:e].tobytes() for s, e in zip(heads, ends)], pa.binary()),
                     pa.array([owners[s:e].tobytes() for s, e in zip(heads, ends)], pa.binary())],
                    ["bucket", "doc_id", "n", "a", "b", "keys", "ids"])
    return run


def _ties(keys, ids, needs):
    """(id, hub, need, count) of the sets that share keys, once each.

    Sets of a key of up to ``PAIRED`` are tied each with each, where ``count`` is the
    number of keys seen and ``need`` that of the keys they share at least if they are
    linked. The others, and all of a key with a set whose ``need`` is 0, are tied to the smallest of their
    key with a ``need`` of 0.
    """
    order = np.lexsort((needs, ids, keys))
    keys, ids, needs = keys[order], ids[order], needs[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
    keys, ids, needs = keys[first], ids[first], needs[first]
    head = np.concatenate([[True], keys[1:] != keys[:-1]])
    heads, group = np.flatnonzero(head), np.cumsum(head) - 1
    sizes = np.diff(np.append(heads, len(keys)))
    star = ((sizes > PAIRED) | (np.minimum.reduceat(needs, heads) == 0))[group]
    at = np.flatnonzero(star & ~head)
    found = [(ids[at], ids[heads[group[at]]], np.zeros(len(at), np.int64))]
    for step in range(1, PAIRED):
        at = np.flatnonzero((group[step:] == group[:-step]) & ~star[step:])
        found.append((ids[at + step], ids[at], np.minimum(needs[at], needs[at + step])))
    docs, hubs, needs = (np.concatenate(x) for x in zip(*found))
    if not len(docs):
        return docs, hubs, needs, needs
    order = np.lexsort((needs, hubs, docs))
    docs, hubs, needs = docs[order], hubs[order], needs[order]
    heads = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (hubs[1:] != hubs[:-1])]))
    return docs[heads], hubs[heads], needs[heads], np.diff(np.append(heads, len(docs)))


def _match(batches):
    """Ties between the sets of each key (ids as doc_id and hub, ``need`` as n, ``count`` as a); rows of documents pass through.

    Rows of keys hold the ``need`` of their sets as n; without one all are tied to hubs.
    """
    names = ["doc_id", "n", "a", "b", "hub"]

    def ties(keys, ids, needs):
        needs = np.repeat([n or 0 for n in needs], [len(k) // 8 for k in keys])
        docs, hubs, needs, counts = _ties(np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(ids), np.int64), needs)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs), pa.array(needs), pa.array(counts), pa.nulls(len(docs), pa.int64()), pa.array(hubs)], names)

    bucket, keys, ids, needs = None, [], [], []
    for batch in batches:
        plain = batch.filter(batch.column("keys").is_null())
        if len(plain):
            yield pa.RecordBatch.from_arrays(
                [*(plain.column(c) for c in names[:4]), pa.nulls(len(plain), pa.int64())], names)
        packed = batch.filter(batch.column("keys").is_valid())
        for b, k, i, n in zip(*(packed.column(c).to_pylist() for c in ("bucket", "keys", "ids", "n"))):
            if b != bucket and keys:
                yield ties(keys, ids, needs)
                keys, ids, needs = [], [], []
            bucket = b
            keys.append(k)
            ids.append(i)
            needs.append(n)
    if keys:
        yield ties(keys, ids, needs)


class Tree:
    """Signature tree over sets: OR-combined bitmaps and size ranges above leaves."""

    def __init__(self, sets, bits):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            bit = s & np.uint64(bits - 1)
            np.bitwise_or.at(self.maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        # what a set may have in common beyond its bits
        self.excess = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.nodes = []
        self._build(0, len(sets))

    def _build(self, lo, hi):
        """Index of the node of rows lo..hi; children come before it."""
        if hi - lo <= LEAF:
            children = ()
        else:
            step = -(-(hi - lo) // 4)
            children = tuple(self._build(at, min(hi, at + step)) for at in range(lo, hi, step))
        self.nodes.append((lo, hi, children, np.bitwise_or.reduce(self.maps[lo:hi]), int(self.sizes[lo:hi].min()),
                           int(self.sizes[lo:hi].max()), int(self.excess[lo:hi].max())))
        return len(self.nodes) - 1


def link_sets(ids, sets, label, first, num=NUM, den=DEN):
    """Links that connect all sets which are connected, without those known from ``label``.

    Rows before ``first`` are one side and the rest the other: pairs inside the first
    side are left out (done elsewhere) unless ``first`` is 0.
    """
    need = lambda a, b: num * (a + b)  # noqa: E731  overlap * (num + den) must reach it
    label = np.unique(np.asarray(label), return_inverse=True)[1]
    bits = 1 << max(9, min(16, (4 * max(map(len, sets)) - 1).bit_length()))
    found = []
    spans = [(0, first), (first, len(sets))] if first else [(0, len(sets))]
    orders = [lo + np.array(sorted(range(hi - lo), key=lambda i: (sets[lo + i][:1].tolist(), len(sets[lo + i]))), np.int64)  # noqa: B023
              for lo, hi in spans]
    trees = [Tree([sets[i] for i in order], bits) for order in orders]
    pairs = [(0, 1), (1, 1)] if first else [(0, 0)]
    for left, right in pairs[::-1]:
        p, q, rows, cols = trees[left], trees[right], orders[left], orders[right]
        stack = [(len(p.nodes) - 1, len(q.nodes) - 1)]
        while stack:
            i, j = stack.pop()
            if left == right and i > j:
                i, j = j, i
            a, b = p.nodes[i], q.nodes[j]
            here, there = label[rows[a[0]:a[1]]], label[cols[b[0]:b[1]]]
            if here[0] == there[0] and (here == here[0]).all() and (there == here[0]).all():
                continue
            if den * a[5] < num * b[4] or den * b[5] < num * a[4]:
                continue
            shared = int(np.bitwise_count(a[3] & b[3]).sum())
            most = min(a[5], b[5], shared + a[6], shared + b[6])
            if most * (num + den) < need(a[4], b[4]):
                continue
            if a[2] or b[2]:
                ones, others = a[2] or (i,), b[2] or (j,)
                same = left == right and i == j
                # pairs of a node with itself are taken first: they connect most
                work = [(x, y) for x in ones for y in others if not same or x <= y]
                stack.extend(sorted(work, key=lambda w: w[0] == w[1]))
                continue
            shared = np.bitwise_count(p.maps[a[0]:a[1], None] & q.maps[None, b[0]:b[1]]).sum(2, dtype=np.int64)
            n, m = p.sizes[a[0]:a[1], None], q.sizes[None, b[0]:b[1]]
            most = np.minimum(np.minimum(n, m), shared + np.minimum(p.excess[a[0]:a[1], None], q.excess[None, b[0]:b[1]]))
            for x, y in zip(*np.nonzero(most * (num + den) >= need(n, m))):
                u, v = rows[a[0] + x], cols[b[0] + y]
                if label[u] == label[v]:
                    continue
                both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                if both * (num + den) >= need(len(sets[u]), len(sets[v])):
                    found.append((ids[u], ids[v]))
                    label[label == label[v]] = label[u]
    return found


def _grouped(batches, num, den):
    """Link the sets of each (subtree, block) group of sorted rows."""
    names = ["label", "block", "hub", "doc_id", "known", "shingles"]

    def links(rows):
        rows.sort(key=lambda r: not r[2])
        first = sum(r[2] for r in rows)
        if first == len(rows):
            first = 0
        return link_sets([r[3] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], [r[4] for r in rows], first, num, den)

    key, rows = None, []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[:2] != key:
                if len(rows) > 1:
                    out += links(rows)
                key, rows = row[:2], []
            rows.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
    if len(rows) > 1 and (out := links(rows)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def _packed(batches, width):
    for batch in batches:
        for ids, sets in _sets(batch, width):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])


def _compare(fetch, plan, num, den, parts, most=None):
    """Links of the sets that ``plan`` (doc_id, label, block, hub, known) deals to groups.

    A plan of more than ``most`` rows is taken in slices of whole groups: each is small
    enough for a broadcast, where a join by shuffle would move all texts and then the sets.
    """
    slices = -(-plan.count() // most) if most else 1
    links = None
    for i in range(slices if 1 < slices <= SLICES else 1):
        mine = save(plan.where(F.pmod(F.xxhash64("label", "block", F.lit(7)), F.lit(slices)) == i)) if 1 < slices <= SLICES else plan
        wanted = save(mine.select("doc_id").distinct())
        rows = fetch(wanted).join(bounded(mine, PLAN_BYTES), "doc_id").select("label", "block", "hub", "doc_id", "known", "shingles")
        rows = rows.repartition(parts, "label", "block").sortWithinPartitions("label", "block")
        found = save(rows.mapInArrow(lambda b: _grouped(b, num, den), "a long, b long"))
        links = found if links is None else links.union(found)
    return links


def grow(stars, fetch, parts, num=NUM, den=DEN, fanout=FANOUT, most=None):
    """Links (a, b) that connect all linked sets within the subtrees that ``stars`` (a, b) tie.

    Two linked sets have a star (a, b) between them or each one to the same b. ``fetch``
    takes a table of doc_id and returns (doc_id, shingles) of these; ``most`` is how many
    rows of a plan meet them at once.
    """
    stars = save(stars.where("a <> b").distinct())
    subtrees = components(stars)
    sizes = subtrees.groupBy("root").agg(F.ceil(F.count("*") / fanout).alias("blocks"))
    plan = save(subtrees.join(bounded(save(sizes), 64), "root").select(
        F.col("vertex").alias("doc_id"), F.col("root").alias("label"), "blocks",
        F.pmod(F.xxhash64("vertex"), "blocks").alias("own"), F.col("vertex").alias("known")))
    others = F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own")))
    dealt = plan.select("doc_id", "label", others.alias("block"), "own", "known").withColumn(
        "hub", (F.col("own") == 0) & (F.col("block") > 0)).drop("own")
    links = _compare(fetch, save(dealt), num, den, parts, most)
    hot = plan.where("blocks > 1")
    if hot.isEmpty():
        return links
    found = components(links).withColumnRenamed("vertex", "doc_id")
    state = save(hot.join(bounded(found, 64), "doc_id", "left").withColumn("known", F.coalesce("root", "doc_id")).drop("root"))
    top = state.groupBy("label", "known").count().groupBy("label").agg(F.max(F.struct("count", "known"))["known"].alias("main"))
    # block 0 has met all; of the others only sets outside the largest component have links to find
    state = state.where("own > 0").join(bounded(save(top), 64), "label")
    state = save(state.select("doc_id", "known", (F.col("known") != F.col("main")).alias("minor")))
    ties = stars.select(F.col("a").alias("doc_id"), F.col("b").alias("label"))
    ties = ties.union(stars.select(F.col("b").alias("doc_id"), F.col("b").alias("label")).distinct())
    members = save(ties.join(bounded(state, 64), "doc_id"))
    sizes = members.groupBy("label").agg(
        F.ceil(F.count("*") / fanout).alias("blocks"), F.ceil(F.count_if("minor") / fanout).alias("minors"),
        F.min("known").alias("low"), F.max("known").alias("high"))
    sizes = save(sizes.where("minors > 0 and low < high").select("label", "blocks", "minors"))
    if sizes.isEmpty():
        return links
    members = save(members.join(bounded(sizes, 64), "label").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks")))
    # the sets of a hub in one block meet each other; of more, each block of minor sets meets each block: group = minor * blocks + own
    every = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("minors") - 1))).alias("m")
    sides = members.select("doc_id", "label", "known", every, "blocks", "own").select(
        "doc_id", "label", (F.col("m") * F.col("blocks") + F.col("own")).alias("block"), "known", F.lit(False).alias("hub"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o")
    minors = members.where("minor and blocks > 1").withColumn("m", F.pmod(F.xxhash64("doc_id", F.lit(1)), "minors")).select(
        "doc_id", "label", "known", "m", other, "blocks").select(
        "doc_id", "label", (F.col("m") * F.col("blocks") + F.col("o")).alias("block"), "known", F.lit(True).alias("hub"))
    return links.union(_compare(fetch, save(sides.union(minors)), num, den, parts, most))


def near_components(docs, width=WIDTH, num=NUM, den=DEN, fanout=FANOUT):
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, class_id, component_id.

    ``class_id`` is the smallest doc_id with the same set of shingles, ``component_id``
    the smallest one reachable by links. Nulls and texts without words have no shingles,
    link with nothing and are their own component. A null doc_id stays alone with null
    ids; rows with the same doc_id are one document that has the links of all its texts.
    Other columns are ignored; no rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    common, total = common_slots(docs, width)
    buckets = max(8, math.ceil(total * 0.35 / KEYS_A_BUCKET))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets / 4))
    emitted = docs.mapInArrow(_emit(common, buckets, width, (den - num) / num), EMITTED)
    matched = save(emitted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_match, MATCHED))
    rows = matched.where("hub is null").drop("hub")
    classes = save(rows.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("class_id")))
    named = save(rows.join(bounded(classes, 64), ["n", "a", "b"], "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")))

    owner = named.where("doc_id is not null and n > 0").select("doc_id", "class_id").distinct()
    owner = bounded(save(owner), 64)
    stars = matched.where("hub is not null").groupBy("doc_id", "hub").agg(F.min("n").alias("need"), F.sum("a").alias("shared"))
    stars = stars.where("shared >= need").select("doc_id", "hub")
    stars = stars.join(bounded(classes, 64).select(F.col("a").alias("doc_id"), F.col("class_id").alias("a")), "doc_id").select("hub", "a")
    stars = stars.join(bounded(classes, 64).select(F.col("a").alias("hub"), F.col("class_id").alias("b")), "hub").select("a", "b")

    def fetch(wanted):
        texts = docs.where("doc_id is not null").join(bounded(wanted, 64), "doc_id", "left_semi")
        return texts.mapInArrow(lambda b: _packed(b, width), "doc_id long, shingles binary").where(F.length("shingles") > 0)

    # a fifth less than a broadcast holds, for slices are uneven
    links = grow(stars, fetch, parts, num, den, fanout, BROADCAST_BYTES // PLAN_BYTES * 4 // 5)
    # one doc_id with several texts ties their classes together
    ties = owner.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b"), F.count("*").alias("k")).where("k > 1")
    ties = owner.join(ties.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b"))
    found = components(links.unionByName(ties))
    least = save(found.groupBy("root").agg(F.min("vertex").alias("component_id")))
    found = save(found.join(bounded(least, 64), "root").select(F.col("vertex").alias("class_id"), "component_id"))
    return named.join(bounded(found, 64), "class_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def representatives(docs, **options):
    """The rows of ``docs`` whose doc_id is the smallest of its component; all columns stay.

    Of rows that repeat a kept doc_id all stay; rows without a doc_id stay.
    """
    keep = near_components(docs, **options).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(bounded(save(keep), 64), "doc_id", "left_anti").select(docs.columns)
