"""Mix sources to target weights from packed token blocks, in built-in expressions only.

Words stand for tokens. The documents of each source, in order of doc_id (nulls first)
and size, are laid end to end and cut into blocks of ``block`` words; the last block of
a source may be shorter. A target of words for every source becomes a number of block
slots. Slots are dealt to output shards: a shard draws its source counts from the
multinomial of the targets with stratified uniforms, so that the counts of all shards
together stay close to the targets. The i-th slot of a source is mapped through a
pseudorandom permutation of the source's block numbers, one for each round through
them, and blocks are joined by (source, number). Nothing depends on partitioning, so
reruns agree.

No task sees a whole source: positions come from sums over at most ``RANGES`` ranges of
doc_id per source, and joins are on (source, block number).

Sizes of nulls and of texts without words are 0; such documents are never taken. A null
source is a source of its own, last in order. Repeated rows are separate documents.
Other columns are ignored. An empty table gives no rows.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from spectralake.llm.tables import bounded
from spectralake.storage import save

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
MOST_SHARDS = 65_536   # beyond, shards get larger
RANGES = 4096
SLOTS_A_TASK = 200_000
# Primes of which at least one divides no block number count below 2**40.
PRIMES = (4194301, 4194287)
ODD = 2654435


def uniform(*parts):
    """A fixed number in [0, 1) for each combination of values."""
    name = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes, share=1.5, most=2.0, weights=WEIGHTS):
    """(source, source_id, source_size, target) from (source, size) rows.

    Sources by code point, null last, have the weights in turn and share ``share`` times
    all words; none gets over ``most`` times its own size, what is over goes to the
    others by weight. That ends at ``least(most * size, level * weight)`` for one level,
    found by ordering sources by the level at which they fill up.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source from here on
    ranked = totals.withColumn("source_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(table, (F.col("source_id") % len(weights)) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    everyone = Window.partitionBy()
    ranked = ranked.select(
        "*", (F.col("cap") / F.col("weight")).alias("ratio"),
        F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        (F.sum("source_size").over(everyone) * F.lit(float(share))).alias("whole"))
    ranked = ranked.withColumn("level", (F.col("whole") - F.col("full")) / F.col("rest"))
    ranked = ranked.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(
        F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everyone))
    return ranked.select("source", "source_id", "source_size",
                         F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def measured(docs, *more):
    """(doc_id, source, size): words of every whole text; and the columns ``more``."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)


def positions(sizes, sources):
    """``sizes`` with source_id and the place of the document's first word in its source."""
    span = sizes.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    # in doubles, which keep the order of ids that lie further apart than a long can tell
    lo, hi = float(span["lo"] or 0), float(span["hi"] or 0)
    width = (hi - lo) / RANGES + 1
    numbered = sizes.join(bounded(sources, 128), sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    numbered = numbered.withColumn("part", F.coalesce(F.floor((F.col("doc_id").cast("double") - lo) / width), F.lit(-1)))
    before = numbered.groupBy("source_id", "part").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source_id", "part", F.coalesce(F.sum("words").over(run), F.lit(0)).alias("base"))
    # with texts, those of one doc_id and size have a fixed order, too
    ties = [F.xxhash64("text"), "text"] if "text" in sizes.columns else []
    inner = Window.partitionBy("source_id", "part").orderBy(F.asc_nulls_first("doc_id"), "size", *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    return numbered.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(
        before, ["source_id", "part"]).withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "part")


def pieces(placed, block=BLOCK_WORDS):
    """The part of each document in each block: ``placed`` with block, first, words.

    ``first`` is the word of the document that the piece begins with. Documents without
    words keep one row with nulls.
    """
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.greatest(F.col("block") * block, F.col("start"))
    end = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    return rows.withColumns({"first": begin - F.col("start"), "words": end - begin})


def permuted(index, n, source_id, turn):
    """Where a pseudorandom permutation of 0..n-1 sends ``index``, one for each source and turn.

    Two rounds of an affine map modulo n and a mixing map of the largest power of two
    within n; each step is one-to-one, for n below 2**40.
    """
    bits = F.length(F.bin(n)) - 1
    power = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    prime = F.when(n % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1])).cast("long")
    x = index
    for step in (1, 2):
        shift = F.floor(uniform(source_id, turn, F.lit(step)) * n)
        x = F.pmod(x * prime + shift, n)
        half = F.greatest(F.floor(bits / 2).cast("int"), F.lit(1))
        mixed = (x.bitwiseXOR(F.call_function("shiftright", x, half)) * F.lit(ODD).cast("long")) % power
        x = F.when((x < power) & (power > 1), mixed).otherwise(x)
    return x


def slots(sources, block=BLOCK_WORDS, per_shard=SHARD_SLOTS, most=2):
    """The mix: (shard, slot, source_id, block), each a block to copy to an output shard."""
    wanted = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    wanted = wanted.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    upto = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    wanted = wanted.select("source_id", "blocks", "want", F.sum("want").over(upto).alias("upto"),
                           F.sum("want").over(Window.partitionBy()).alias("all"))
    shards = F.least(F.greatest(F.ceil(F.col("all") / per_shard), F.lit(1)), F.lit(MOST_SHARDS))
    rows = wanted.withColumn("shards", shards).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))

    def drawn(edge):
        """Stratified draws of the shard below an edge of the sources' shares."""
        place = edge / F.col("shards")
        low = F.floor(place)
        return low + (uniform(F.lit("draw"), F.col("shard"), low) < place - low).cast("long")

    rows = rows.withColumn("below", drawn(F.col("upto") - F.col("want"))).withColumn("count", drawn(F.col("upto")) - F.col("below"))
    ran = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ran", F.coalesce(F.sum("count").over(ran), F.lit(0))).where("count > 0")
    # few rows so far: deal them out by the number of slots they are about to become
    whole = sources.agg(F.sum(F.col("target") / block)).first()[0] or 0
    rows = rows.repartition(math.ceil(whole / SLOTS_A_TASK) + 1, "source_id", "shard")
    rows = rows.select("shard", "source_id", "blocks", "below", "ran", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("k"))
    index = F.col("ran") + F.col("k")
    turn = F.floor(index / F.col("blocks"))
    rows = rows.where(turn < most)  # no block more than ``most`` times
    return rows.select("shard", (F.col("below") + F.col("k")).alias("slot"), "source_id",
                       permuted(index % F.col("blocks"), F.col("blocks"), F.col("source_id"), turn).alias("block"))


def plan(docs, block=BLOCK_WORDS, *more):
    """(sources, placed documents with the columns ``more``, slots) of a mix of ``docs``."""
    sizes = save(measured(docs, *more))
    sources = save(source_targets(sizes))
    return sources, positions(sizes, sources), slots(sources, block)


def taken(docs, block=BLOCK_WORDS):
    """doc_id, size, source_size, target, taken (words that the mix takes) of every row."""
    _, placed, dealt = plan(docs, block)
    times = dealt.groupBy("source_id", "block").agg(F.count("*").alias("times"))
    # sizes behind generated rows are guessed far too low: both sides are large, so merge
    rows = pieces(placed, block).join(times.hint("merge"), ["source_id", "block"], "left")
    # rows with words differ in their start; equal rows without any are counted
    sums = rows.groupBy("source_id", "start", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"),
        F.when(F.col("size") == 0, F.count("*")).otherwise(1).cast("int").alias("copies"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return sums.withColumn("copy", copies).select("doc_id", "size", "source_size", "target", "taken")


def packed(placed, block=BLOCK_WORDS):
    """(source_id, source, doc_id, block, place, first, words, text) of every piece of ``placed`` texts.

    ``text`` holds the piece's words with a blank between, ``place`` is where it begins in
    its block. Documents without words have no piece.
    """
    tokens = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    number, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)

    def piece(number):
        begin, end = F.greatest(number * block, F.col("start")), F.least((number + 1) * block, F.col("start") + F.col("size"))
        some = F.slice("tokens", (begin - F.col("start") + 1).cast("int"), (end - begin).cast("int"))
        return F.struct(number.alias("block"), (begin - number * block).alias("place"), (begin - F.col("start")).alias("first"),
                        (end - begin).alias("words"), F.array_join(some, " ").alias("text"))

    # all pieces of a text are cut in its one row: no copy of the text for each
    cut = placed.where("size > 0").withColumn("tokens", tokens).select(
        "source_id", "source", "doc_id", F.explode(F.transform(F.sequence(number, last), piece)).alias("piece"))
    return cut.select("source_id", "source", "doc_id", "piece.*")


def mixed(docs, block=BLOCK_WORDS):
    """The mix itself: shard, slot, source, block, place, doc_id, first, words, text of every piece.

    The texts of a slot by ``place`` are the tokens of its block.
    """
    _, placed, dealt = plan(docs, block, "text")
    rows = packed(placed, block).join(dealt.hint("merge"), ["source_id", "block"])
    return rows.select("shard", "slot", "source", "block", "place", "doc_id", "first", "words", "text")


TAKEN_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  row_number() OVER () AS row_id FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_id FROM s GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][source_id % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM t),
f AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS whole,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER (ORDER BY cap / weight, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT arg_min((whole - filled) / rest, ratio) AS level FROM f WHERE (whole - filled) / rest <= ratio),
src AS (SELECT source, source_id, source_size, least(cap, coalesce(level * weight, cap)) AS target,
               CAST(ceil(source_size / 64.0) AS BIGINT) AS blocks FROM f, l),
placed AS (SELECT s.*, src.source_id, src.source_size, src.target, CAST(coalesce(sum(size) OVER (PARTITION BY src.source_id
               ORDER BY doc_id NULLS FIRST, size, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
           FROM s JOIN src ON s.source IS NOT DISTINCT FROM src.source),
piece AS (SELECT *, least((block + 1) * 64, start + size) - greatest(block * 64, start) AS words
          FROM (SELECT *, unnest(range(start // 64, (start + size - 1) // 64 + 1)) AS block FROM placed WHERE size > 0)),
want AS (SELECT *, target * blocks / source_size AS want FROM src WHERE source_size > 0),
upto AS (SELECT *, sum(want) OVER (ORDER BY source_id) AS upto, sum(want) OVER () AS total FROM want),
sh AS (SELECT *, unnest(range(CAST(shards AS BIGINT))) AS shard FROM (
           SELECT *, least(greatest(ceil(total / 1024), 1), 65536) AS shards FROM upto)),
edge AS (SELECT *, (upto - want) / shards AS p0, upto / shards AS p1 FROM sh),
drawn AS (SELECT *, CAST(floor(p0) AS BIGINT) + CASE WHEN ('0x' || substr(md5('draw:' || shard || ':' || CAST(floor(p0) AS BIGINT)), 1, 8))::BIGINT
                 / 4294967296.0 < p0 - floor(p0) THEN 1 ELSE 0 END AS below,
             CAST(floor(p1) AS BIGINT) + CASE WHEN ('0x' || substr(md5('draw:' || shard || ':' || CAST(floor(p1) AS BIGINT)), 1, 8))::BIGINT
                 / 4294967296.0 < p1 - floor(p1) THEN 1 ELSE 0 END AS above FROM edge),
ran AS (SELECT *, above - below AS n, CAST(coalesce(sum(above - below) OVER (PARTITION BY source_id ORDER BY shard
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ran FROM drawn),
slot AS (SELECT source_id, blocks, (ran + k) % blocks AS x0, (ran + k) // blocks AS turn FROM (
             SELECT *, unnest(range(n)) AS k FROM ran WHERE n > 0)),
p AS (SELECT *, length(bin(blocks)) - 1 AS bits, CASE WHEN blocks % 4194301 <> 0 THEN 4194301 ELSE 4194287 END AS prime
      FROM slot WHERE turn < 2),
a1 AS (SELECT *, (x0 * prime + CAST(floor(('0x' || substr(md5(source_id || ':' || turn || ':1'), 1, 8))::BIGINT / 4294967296.0 * blocks) AS BIGINT))
             % blocks AS x1, 1::BIGINT << bits AS power, greatest(bits // 2, 1) AS half FROM p),
b1 AS (SELECT *, CASE WHEN x1 < power AND power > 1 THEN (xor(x1, x1 >> half) * 2654435) % power ELSE x1 END AS y1 FROM a1),
a2 AS (SELECT *, (y1 * prime + CAST(floor(('0x' || substr(md5(source_id || ':' || turn || ':2'), 1, 8))::BIGINT / 4294967296.0 * blocks) AS BIGINT))
             % blocks AS x2 FROM b1),
b2 AS (SELECT source_id, CASE WHEN x2 < power AND power > 1 THEN (xor(x2, x2 >> half) * 2654435) % power ELSE x2 END AS block FROM a2),
times AS (SELECT source_id, block, count(*) AS times FROM b2 GROUP BY ALL),
sums AS (SELECT row_id, sum(words * times) AS taken FROM piece JOIN times USING (source_id, block) GROUP BY row_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN sums USING (row_id)
"""
