"""Audit of how filters interact, by count-weighted decision diagrams.

A document's failure mask says which of the filters it fails. Spark counts the masks of
each part (a source), so a part comes down to at most one row for each mask, whatever the
number of its documents; hot sources are added up where they are read.

The counts of a part make a zero-suppressed decision diagram: a node asks for one filter,
its low child holds the masks that pass it, its high child those that fail it, a node
without failures is left out, equal nodes are one, leaves hold counts (documents, good
ones, toxic ones) and every node the sum of what lies below. Exchanging two adjacent
levels rebuilds only the nodes above and on them, and a walk of such exchanges meets all
orders of the filters. In an order's diagram the path of low children from the root is
that of the documents that pass: each high child on it is what that step removes.

Sums over a whole order follow from the same paths: all failures of a filter are what it
removes where it comes first, failures of it alone what it removes where it comes last.

The five filters fail a document if it has under 200 words (A), if its distinct words are
less than half of them (B), if over 2 % of its code points are A-Z (C), if it holds any of
``#$%&*|`` (D), if a smaller doc_id has the same text (E). Words are
``[^\\x20\\x09-\\x0D]+``, case-sensitive. Copies are told by the sha256 of the text; rows of a
text and part with equal labels are counted before they meet, so a text held by a third of
all rows comes down to a few rows for each part.

Null texts are empty, null sources the part ``""``, like empty ones. A row with a null
doc_id fails no E and makes no other row fail it; rows that share the smallest doc_id pass.
A doc_id with several labels has each that any of them gives. Empty tables give no rows;
long texts are split piece by piece. Other columns are ignored.
"""

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import functions as F

from spectralake.llm import text as T
from spectralake.llm.tables import bounded
from spectralake.storage import save

NAMES = "ABCDE"
LEAST_WORDS = 200
SIGNS = b"#$%&*|"
UPPER = bytes(range(0x41, 0x5B))
INSIDE = bytes(range(0x80, 0xC0))     # bytes of a code point after its first


def _words(raw):
    """(words, distinct words) of the bytes of a text."""
    n, distinct = 0, set()
    for piece in T.pieces(raw):
        some = piece.split()            # at 0x20 and 0x09 to 0x0D, as it is bytes
        n += len(some)
        distinct.update(some)
    return n, len(distinct)


def failures(raw):
    """The mask of the filters A to D that the text's bytes fail; bit 0 is A."""
    words, distinct = _words(raw)
    points = len(raw) - (0 if raw.isascii() else len(raw) - len(raw.translate(None, INSIDE)))
    capitals = len(raw) - len(raw.translate(None, UPPER))
    signs = len(raw.translate(None, SIGNS)) < len(raw)
    return (words < LEAST_WORDS) | (100 * distinct < 50 * words) << 1 | (100 * capitals > 2 * points) << 2 | signs << 3


def measured(docs):
    """(doc_id, part, text_hash, mask) of every row of ``docs``, its whole text read; E is not among the mask yet."""
    def run(batches):
        for batch in batches:
            masks, hashes = [], []
            for raw in T.raw_texts(batch.column(2)):
                masks.append(failures(raw))
                hashes.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(masks, pa.int32())],
                                             ["doc_id", "part", "text_hash", "mask"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, part string, text_hash binary, mask int")


def mask_counts(docs, labels):
    """(part, mask, docs, good, toxic): how many documents of a part fail just the filters of a mask."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = measured(docs).join(bounded(save(marks), 32), "doc_id", "left")
    # one row for each text, part, label and id; the next sum is of texts without their ids
    kind = ["text_hash", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    ids = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    groups = save(ids.groupBy("text_hash", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")))
    first = groups.groupBy("text_hash").agg(F.min("least").alias("first"))
    groups = groups.join(first, "text_hash")
    passing = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    copies = 1 << NAMES.index("E")
    split = groups.select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", passing.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(copies)).alias("mask"), (F.col("n") - passing).alias("n")))).alias("m"))
    return split.groupBy("part", "m.mask").agg(
        F.sum("m.n").alias("docs"), F.sum(F.when(F.col("good"), F.col("m.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("m.n")).otherwise(0)).alias("toxic"))


class Diagram:
    """The diagram of one part: ``counts`` maps masks to (docs, good, toxic); filters are numbers."""

    def __init__(self, counts, n):
        self.nodes = {}            # (filter, low, high) -> node
        self.order = list(range(n))
        self.empty = (None, None, None, (0, 0, 0))
        self.root = self._built([(m, tuple(c)) for m, c in counts.items() if any(c)], 0)

    def _built(self, rows, level):
        if not rows:
            return self.empty
        if level == len(self.order):
            return self._node(None, None, None, tuple(map(sum, zip(*(c for _, c in rows)))))
        low = self._built([r for r in rows if not r[0] >> level & 1], level + 1)
        return self._node(level, low, self._built([r for r in rows if r[0] >> level & 1], level + 1))

    def _node(self, name, low, high, count=None):
        if high is self.empty:
            return low             # no document fails here: no question to ask
        if count is None:
            count = tuple(map(sum, zip(low[3], high[3])))
        return self.nodes.setdefault((name, id(low), id(high), count), (name, low, high, count))

    def _asked(self, node, name):
        """(low, high) of ``node`` for the filter ``name``, which it need not ask for."""
        return (node[1], node[2]) if node[0] == name else (node, self.empty)

    def swap(self, level):
        """Exchange the filters at ``level`` and ``level + 1``."""
        upper, lower = self.order[level:level + 2]
        above = set(self.order[:level])
        done = {}

        def moved(node):
            if node[0] in above:
                if id(node) not in done:
                    done[id(node)] = self._node(node[0], moved(node[1]), moved(node[2]))
                return done[id(node)]
            low, high = self._asked(node, upper)
            (pass_pass, pass_fail), (fail_pass, fail_fail) = self._asked(low, lower), self._asked(high, lower)
            if pass_fail is fail_fail is self.empty and node[0] != lower and high is self.empty:
                return node
            return self._node(lower, self._node(upper, pass_pass, fail_pass), self._node(upper, pass_fail, fail_fail))

        self.root = moved(self.root)
        self.order[level:level + 2] = lower, upper

    def path(self):
        """(filter, kept, removed) of each step of the present order; the last two are counts."""
        node = self.root
        for name in self.order:
            low, high = self._asked(node, name)
            yield name, low[3], high[3]
            node = low


def exchanges(n):
    """Levels to exchange one after another so that all orders of ``n`` filters are met once each.

    The last filter walks down and up through the others; between two walks the others make
    a step of their own, above or below it.
    """
    if n < 2:
        return []
    others, walk = exchanges(n - 1), list(range(n - 1))
    steps, down = [], False
    for other in [*others, None]:
        steps += walk if down else walk[::-1]
        # the walker stands at the top after an upward walk and shifts the others by one
        if other is not None:
            steps.append(other if down else other + 1)
        down = not down
    return steps


def steps_of(counts, names=NAMES):
    """One tuple for each order and step from a part's ``counts`` by mask.

    (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    """
    diagram, n = Diagram(counts, len(names)), len(names)
    paths = []
    for level in [None, *exchanges(n)]:
        if level is not None:
            diagram.swap(level)
        paths.append(list(diagram.path()))
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for path in paths:
        fails[path[0][0]] = path[0][2][0]
        alone[path[-1][0]] = path[-1][2][0]
        for name, _, removed in path:
            shapley[name] += removed[0]
    for path in paths:
        order = "".join(names[p[0]] for p in path)
        for step, (name, kept, removed) in enumerate(path, 1):
            yield order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shapley[name]


STEP = "filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts, names=NAMES):
    """Every part, order of the filters and step of ``counts`` (part, mask, docs, good, toxic)."""
    def run(batches):
        for batch in batches:
            for part, masks in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = steps_of({m["mask"]: (m["docs"], m["good"], m["toxic"]) for m in masks}, names)
                columns = list(zip(*rows))
                types = [pa.string(), pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(columns[0]), pa.string()),
                                                  *(pa.array(c, t) for c, t in zip(columns, types))],
                                                 ["part", *(f.split()[0] for f in STEP.split(", "))])

    # at most one entry for each mask
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks"))
    return parts.mapInArrow(run, f"part string, {STEP}")


def report(docs, labels):
    """part, filter_order, step and the counts of ``steps_of``: 600 rows for every part of ``docs``."""
    return audit(mask_counts(docs, labels))


def orders(names=NAMES):
    """All orders of the filters, for tests."""
    return {"".join(p) for p in itertools.permutations(names)}


REPORT_SQL = r"""
WITH m AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
        coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM m LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY part, mask),
v AS (SELECT chr(CAST(65 + i AS INT)) AS name, CAST(pow(2, i) AS INT) AS bit FROM range(5) r(i)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM v a, v b, v c, v d, v e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, CAST(k AS INT) AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INT) AS earlier
      FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (earlier | bit) = 0) AS kept, sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
        sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0) AS good_lost,
        sum(bad) FILTER (mask & earlier = 0 AND mask & bit > 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
