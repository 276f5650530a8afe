"""Repeated paragraphs across documents: MinHash bands, exact check, components.

A paragraph is a line of ``MIN_WORDS`` words or more (``[^\\x20\\x09-\\x0D]+``, A-Z
lower-cased); shorter lines are boilerplate of their own and stay. Its set holds the
distinct five-word shingles. Bands of ``ROWS`` minima each are as many as find a pair at
the threshold with probability ``RECALL``. Paragraphs that collide in a band form a
subtree, in which pairs are compared exactly (100 * intersection >= 80 * union) until all
linked ones are connected; see ``ngram_join.grow`` for hot groups. Of each component the
paragraph of smallest (doc_id, line) stays; every other one is a removal.

``repeats`` goes over all words. With ``joined``, neighbouring lines under ``MIN_WORDS``
words, up to a blank or a longer line, count as one paragraph, so hard-wrapped text is
banded as well. In what the paragraphs leave of the texts, ``passages`` finds exact repeats
wherever they stand: of every ``WINDOW`` five-word shingles in a row the one of smallest
hash is a mark, and from each mark on to the first one that makes it ``MIN_WORDS`` words
goes a unit. Marks depend on nothing outside their window, so any run of 50 equal words
holds a whole unit in both places, whatever surrounds it. Of equal units that at the
smallest (doc_id, text, word) stays. Each removed word therefore stands in a text that
keeps it.

Equal paragraphs are one from the start and are sent once a task. Null and empty texts
have no paragraphs; rows without a doc_id are left alone; rows that repeat a doc_id have
their lines counted together. Other columns stay out of the way; no rows give no removals.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectralake.llm import ngram_join as forest
from spectralake.llm import text as T
from spectralake.llm.tables import bounded, components, free_name
from spectralake.storage import save

WIDTH = 5
MIN_WORDS = 25
NUM, DEN = 80, 100
ROWS = 4
RECALL = 0.9995
WINDOW = 12             # shingles of which one is a mark: 2 * WINDOW + MIN_WORDS words hold a unit
LINE_BITS = 31          # a paragraph's place: its first line, then its number of lines
SEEN_AT_ONCE = 200_000   # paragraphs a task remembers as sent


def bands_for(threshold=NUM / DEN, rows=ROWS, recall=RECALL):
    """The fewest bands that find a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def _paragraphs(batch, joined=False, width=WIDTH, least=MIN_WORDS):
    """Per block: (row, place, words, identity, shingles, paragraph of each shingle)."""
    for lo, hi, data, offsets in T.blocks(batch.column("text")):
        breaks = np.flatnonzero(data == 0x0A) + 1
        bounds = np.unique(np.concatenate([offsets, breaks]))
        if len(bounds) < 2:
            continue
        words, line, _, _ = T.word_hashes(data, bounds)
        row = np.searchsorted(offsets, bounds[:-1], "right") - 1
        number = np.arange(len(row)) - np.searchsorted(row, row)
        count = np.bincount(line, minlength=len(row))
        lines = np.ones(len(row), np.int64)
        if joined:
            alone = (count >= least) | (count == 0)
            begins = np.concatenate([[True], alone[1:] | alone[:-1] | (row[1:] != row[:-1])])
            line = (np.cumsum(begins) - 1)[line]
            heads = np.flatnonzero(begins)
            lines, count = np.diff(np.append(heads, len(row))), np.add.reduceat(count, heads)
            row, number = row[heads], number[heads]
        number = (number << LINE_BITS) | lines
        kept = count >= least
        if not kept.any():
            continue
        hashes, owner = T.shingle_hashes(words, line, len(row), width)
        long = kept[owner]
        hashes, owner = hashes[long], (np.cumsum(kept) - 1)[owner[long]]
        heads = np.searchsorted(owner, np.arange(int(kept.sum())))
        # the order of shingles counts, so equal identities are equal paragraphs
        place = T.mix((np.arange(len(hashes)) - heads[owner]).astype(np.uint64) + T.PLACES[7])
        identity = T.mix(np.add.reduceat(T.mix(hashes ^ place), heads)).view(np.int64)
        yield lo + row[kept], number[kept], count[kept], identity, hashes, owner, heads


def _band_keys(hashes, heads, bands, rows):
    """(paragraphs, bands) keys."""
    keys = []
    for band in range(bands):
        key = np.uint64(band)
        for r in range(rows):
            seed = T.mix(np.array([band * rows + r + 1], np.uint64) * T.PLACES[11])
            key = T.mix(key + np.minimum.reduceat((hashes ^ seed) * T.PLACES[13], heads))
        keys.append(key)
    return np.stack(keys, 1)


def _emit(buckets, bands, rows, joined):
    names = ["bucket", "doc_id", "n", "a", "b", "keys", "ids"]

    def run(batches):
        seen = set()
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for row, line, count, identity, hashes, _, heads in _paragraphs(batch, joined):
                n = len(row)
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array((T.mix(identity.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)), ids.take(pa.array(row)),
                     pa.array(count), pa.array(identity), pa.array(line), none, none], names)
                fresh = np.array([i not in seen for i in identity.tolist()])
                seen.update(identity.tolist())
                if len(seen) > SEEN_AT_ONCE:
                    seen.clear()
                if not fresh.any():
                    continue
                keys = _band_keys(hashes, heads, bands, rows)[fresh]
                owners = np.repeat(identity[fresh], bands)
                keys = keys.ravel()
                bucket = T.mix(keys) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                keys, owners, bucket = keys[order], owners[order], bucket[order].astype(np.int32)
                begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(begins[1:], len(keys))
                none = pa.nulls(len(begins), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begins]), none, none, none, none,
                     pa.array([keys[s:e].tobytes() for s, e in zip(begins, ends)], pa.binary()),
                     pa.array([owners[s:e].tobytes() for s, e in zip(begins, ends)], pa.binary())], names)
    return run


def _sets(joined):
    """Sets of all paragraphs, each once a task."""
    def run(batches):
        seen = set()
        for batch in batches:
            for _, _, _, identity, hashes, _, heads in _paragraphs(batch, joined):
                ends = np.append(heads[1:], len(hashes))
                picked = [i for i in range(len(identity)) if identity[i] not in seen]
                seen.update(identity[picked].tolist())
                if len(seen) > SEEN_AT_ONCE:
                    seen.clear()
                if len(picked):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(identity[picked]), pa.array([np.unique(hashes[heads[i]:ends[i]]).tobytes() for i in picked], pa.binary())],
                        ["doc_id", "shingles"])
    return run


def components_of(docs, rows=ROWS, recall=RECALL, num=NUM, den=DEN, fanout=forest.FANOUT, joined=False):
    """(doc_id, line, lines, words, paragraph, component) of every paragraph; saved."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    bands = bands_for(num / den, rows, recall)
    sized = docs.select(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    # some 150 characters a paragraph
    buckets = max(8, math.ceil(sized / 150 * bands / forest.KEYS_A_BUCKET))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets / 4))
    emitted = docs.mapInArrow(_emit(buckets, bands, rows, joined), forest.EMITTED)
    matched = save(emitted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(forest._match, forest.MATCHED))
    stars = matched.where("hub is not null").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))

    def fetch(wanted):
        every = docs.mapInArrow(_sets(joined), "doc_id long, shingles binary")
        return every.join(bounded(wanted, 16), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("shingles").alias("shingles"))

    found = components(forest.grow(stars, fetch, parts, num, den, fanout))
    lines = matched.where("hub is null").select("doc_id", F.call_function("shiftright", "b", F.lit(LINE_BITS)).alias("line"),
                                               (F.col("b") % (1 << LINE_BITS)).alias("lines"), F.col("n").alias("words"), F.col("a").alias("paragraph"))
    found = found.withColumnRenamed("vertex", "paragraph")
    return save(lines.join(bounded(found, 64), "paragraph", "left").select(
        "doc_id", "line", "lines", "words", "paragraph", F.coalesce("root", "paragraph").alias("component")))


def removals(docs, **options):
    """doc_id, line, lines, words, kept_doc_id, kept_line, component, exact: one row per paragraph to remove.

    ``line`` counts from 0 and ``lines`` is how many follow from it, 1 unless ``joined``;
    ``exact`` tells whether it equals the kept one.
    """
    lines = components_of(docs, **options)
    kept = lines.groupBy("component").agg(F.min(F.struct("doc_id", "line", "paragraph")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    rows = lines.join(bounded(save(kept.drop("n")), 96), "component")
    rows = rows.where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("line") != F.col("kept.line")))
    return rows.select("doc_id", "line", "lines", "words", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line"),
                       "component", (F.col("paragraph") == F.col("kept.paragraph")).alias("exact"))


def _without_lines(docs, found):
    """``docs`` with the paragraphs of ``found`` (a table of removals) taken out of ``text``."""
    mark = free_name(docs, "_gone")
    lines = F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)).alias("line")
    gone = found.select("doc_id", lines).groupBy("doc_id").agg(F.collect_set("line").alias(mark))
    rows = docs.join(bounded(save(gone), 1024), "doc_id", "left")
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(mark, i.cast("long")))
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select([text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def _units(batches):
    """doc_id, text_id, first, words, identity of the units of every text."""
    for batch in batches:
        ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text_id")
        for lo, hi, data, offsets in T.blocks(batch.column("text")):
            words, doc, _, _ = T.word_hashes(data, offsets)
            n = len(words) - WIDTH - WINDOW + 2
            if n < 1:
                continue
            shingles = np.zeros(len(words) - WIDTH + 1, np.uint64)
            for j in range(WIDTH):
                shingles += words[j:len(shingles) + j] * T.PLACES[j]
            shingles = T.mix(shingles)
            least, place = shingles[:n].copy(), np.arange(n)
            for j in range(1, WINDOW):
                less = shingles[j:n + j] < least
                least[less] = shingles[j:n + j][less]
                place[less] = np.flatnonzero(less) + j
            marks = np.unique(place[doc[:n] == doc[WIDTH + WINDOW - 2:]])
            at = np.searchsorted(marks, marks + MIN_WORDS - WIDTH)
            begin, end = marks[at < len(marks)], marks[at[at < len(marks)]] + WIDTH
            same = doc[begin] == doc[end - 1]
            begin, end = begin[same], end[same]
            size = end - begin
            total = size.astype(np.uint64) * T.PLACES[63]
            for j in range(int(size.max(initial=0))):
                inside = j < size
                total[inside] += words[begin[inside] + j] * T.PLACES[j]
            row = doc[begin]
            first = begin - np.searchsorted(doc, row)
            at = pa.array(lo + row)
            yield pa.RecordBatch.from_arrays(
                [ids.take(at), texts.take(at), pa.array(first), pa.array(size), pa.array(T.mix(total).view(np.int64))],
                ["doc_id", "text_id", "first", "words", "identity"])


def passages(docs):
    """doc_id, text_id, first, words, kept_doc_id, kept_first, identity: one row per repeated unit.

    ``first`` is the number of the unit's first word in its text, from 0; ``text_id`` is the
    text's xxhash64, as rows may share a doc_id. Units of a run overlap.
    """
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    units = save(rows.mapInArrow(_units, "doc_id long, text_id long, first long, words long, identity long"))
    place = F.struct("doc_id", "text_id", "first")
    kept = units.groupBy("identity").agg(F.min(place).alias("kept"), F.max(place).alias("last")).where("kept <> last")
    found = units.join(bounded(save(kept.drop("last")), 64), "identity").where(place != F.col("kept"))
    return found.select("doc_id", "text_id", "first", "words", F.col("kept.doc_id").alias("kept_doc_id"),
                        F.col("kept.first").alias("kept_first"), "identity").distinct()


def repeats(docs, **options):
    """One row per repeat: paragraphs (``first`` null), then passages in the texts without them (``line`` null)."""
    found = save(removals(docs, joined=True, **options))
    rest = passages(_without_lines(docs.select("doc_id", "text"), found))
    return found.withColumns({"first": F.lit(None).cast("long"), "kept_first": F.lit(None).cast("long")}).unionByName(
        rest.drop("text_id").withColumnRenamed("identity", "component").withColumn("exact", F.lit(True)), allowMissingColumns=True)


def _cut(at, spans):
    """Take the words of the spans (first, words) out of the texts of batches."""
    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, some in enumerate(batch.column(spans).to_pylist()):
                if some:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    starts, ends, _ = T.word_bounds(data, np.array([0, len(data)]), T.NOT_SPACE)
                    gone = np.zeros(len(data), bool)
                    for first, words in some:
                        gone[starts[first]:ends[first + words - 1]] = True
                    texts[i] = data[~gone].tobytes().decode()
            columns = [pa.array(texts, c.type) if k == at else c for k, c in enumerate(batch.columns) if k != spans]
            yield pa.RecordBatch.from_arrays(columns, [n for k, n in enumerate(batch.schema.names) if k != spans])
    return run


def without_repeats(docs, **options):
    """``docs`` with repeated paragraphs and passages taken out of ``text``; all columns and rows stay."""
    rest = save(_without_lines(docs, removals(docs, joined=True, **options)))
    gone = passages(rest).groupBy(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text")).agg(
        F.collect_set(F.array("first", "words")).alias("_spans"))
    at = rest.columns.index("text")
    plain = rest.select([rest[c].alias(f"c{i}") for i, c in enumerate(rest.columns)] + [
        rest["doc_id"].alias("_id"), F.xxhash64(rest["text"]).alias("_key")])
    plain = plain.join(bounded(save(gone), 2048), (F.col("_id") == F.col("_doc")) & (F.col("_key") == F.col("_text")), "left")
    plain = plain.select(*[f"c{i}" for i in range(len(rest.columns))], "_spans")
    done = plain.mapInArrow(_cut(at, len(rest.columns)), ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(rest.dtypes)))
    return done.toDF(*rest.columns)
