"""Importance resampling of documents towards a target text by hashed n-grams.

A table of 256 bytes lower-cases A-Z and turns every other ASCII character that is no
letter or digit into a blank, on the UTF-8 bytes; ``bytes.split`` then gives the words.
The crc32 of an n-gram's words joined by blanks is that of its first n-1 words taken as the
seed for a blank and the last word, so longer n-grams cost one more step and no joining.
Features are all runs of 1 to ``most`` words, repeats counted; their crc32 modulo
``buckets`` is a bucket. Each task reduces its features in a Counter of at most
``buckets`` entries, and Spark sums these tables over all documents.

A bucket's gain is floor(1000 ln) of its smoothed share in the target texts over that in
all documents; a document's weight is the floored mean of its features' gains, and its
score adds Gumbel noise from its id. The ``percent`` highest scores of the documents with
at least ``least`` words are a draw without replacement in proportion to the weights.

No task sorts all documents: scores are ranged over partitions, each is sorted by itself,
and the rows before a partition are added. Equal scores go by doc_id, nulls last, then by
a row number, which also spreads a group of equal rows over partitions.

Null and empty texts and texts without words have no features and weight 0. A null doc_id
counts as an empty one in the noise. Repeated rows are documents of their own. Long texts
are read piece by piece. Empty tables give no rows; without target texts all gains come
from the smoothing. Other columns stay out of the way.
"""

import math
from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectralake.llm import text as T
from spectralake.llm.tables import free_name
from spectralake.storage import save

BUCKETS = 10_000
MOST = 2               # words of the longest features
SMOOTH = 1
LEAST = 20             # words of a document that may be drawn
PERCENT = 25
SEED = 7
ROWS = 20_000          # documents that one task ranks, as long as there are few

TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(raw, most=MOST):
    """Lists of the crc32 of all runs of 1 to ``most`` words of the bytes ``raw``, lists of single words first in each piece."""
    carried = []
    for piece in T.pieces(raw):
        words = carried + piece.translate(TABLE).split()
        runs = list(map(crc32, words))
        yield runs[len(carried):]
        for n in range(2, most + 1):
            runs = list(map(crc32, words[n - 1:], map(crc32, repeat(b" "), runs)))
            # runs that end within the carried words were given before
            yield runs[max(0, len(carried) - n + 1):]
        carried = words[len(words) - min(most - 1, len(words)):]


def bucket_counts(texts, buckets=BUCKETS, most=MOST):
    """(bucket, n) over all rows of ``texts``; rows of a task are reduced before they are shuffled."""
    def run(batches):
        total = Counter()
        for batch in batches:
            for raw in T.raw_texts(batch.column(0)):
                for hashes in features(raw, most):
                    total.update(h % buckets for h in hashes)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([total[b] for b in names], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def _table(texts, buckets, most):
    counts = np.zeros(buckets, np.int64)
    for r in bucket_counts(texts, buckets, most).collect():     # at most ``buckets`` rows
        counts[r["bucket"]] = r["n"]
    return counts


def gains(docs, target, buckets=BUCKETS, most=MOST, smooth=SMOOTH):
    """Each bucket's gain, from the counts of all rows of both tables."""
    source, wanted = _table(docs, buckets, most), _table(target, buckets, most)
    s, t = int(source.sum()) + smooth * buckets, int(wanted.sum()) + smooth * buckets
    return np.array([math.floor(1000 * math.log((float(x) + smooth) * s / ((float(y) + smooth) * t)))
                     for x, y in zip(wanted, source)], np.int64)


def weighed(docs, gain, columns, name="resampling", most=MOST):
    """``columns`` of every row with struct ``name``: n_words, n_features, weight."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            words, counts, weights = [], [], []
            for raw in T.raw_texts(batch.column(batch.schema.get_field_index("_text"))):
                n_words = n = total = 0
                for i, hashes in enumerate(features(raw, most)):
                    n_words += len(hashes) if i % most == 0 else 0
                    n += len(hashes)
                    total += int(gain[np.array(hashes, np.int64) % buckets].sum())
                words.append(n_words)
                counts.append(n)
                weights.append(total // n if n else 0)
            kept = batch.select([f for f in batch.schema.names if f != "_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, pa.int64()) for x in (words, counts, weights))],
                                             [*kept.schema.names, "_words", "_features", "_weight"])

    plain = docs.select([docs[c].alias(f"c{i}") for i, c in enumerate(columns)] + [docs["text"].alias("_text")])
    types = dict(docs.dtypes)
    fields = "".join(f"c{i} {types[c]}, " for i, c in enumerate(columns))
    done = plain.mapInArrow(run, f"{fields}_words long, _features long, _weight long")
    return done.select([F.col(f"c{i}").alias(c) for i, c in enumerate(columns)] + [
        F.struct(F.col("_words").alias("n_words"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight")).alias(name)])


def noise(doc_id, seed=SEED):
    """floor(1000 g), g Gumbel noise fixed by ``doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(docs, target, columns=None, name="resampling", percent=PERCENT, least=LEAST, seed=SEED):
    """``columns`` (all, if None) of every row of ``docs`` with struct ``name``: n_words, n_features, weight, score, rank.

    ``rank`` is null for what is not drawn.
    """
    columns = docs.columns if columns is None else columns
    rows = weighed(docs, gains(docs, target), columns, name)
    score = (F.col(name)["weight"] + noise(F.col("doc_id"), seed)).cast("long")
    row, place, before = (free_name(rows, n) for n in ("_row", "_place", "_before"))
    rows = save(rows.withColumn(name, F.col(name).withField("score", score)).withColumn(row, F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("rows"), F.count_if(F.col(name)["n_words"] >= least).alias("able")).first()
    drawn = percent * size["able"] // 100
    able = F.col(name)["n_words"] >= least
    order = [able.desc(), F.col(name)["score"].desc(), F.asc_nulls_last("doc_id"), F.col(row)]
    parts = min(size["rows"] // ROWS + 1, 10_000)
    # the id's upper bits number the partition, the lower ones the row within
    sorted_ = save(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, 33)
    counts = sorted_.groupBy(part.alias(before)).count().collect()      # one row a partition
    starts, total = [], 0
    for r in sorted(counts):
        starts.append((r[before], total))
        total += r["count"]
    starts = docs.sparkSession.createDataFrame(starts, f"_part long, {before} long")
    rank = (F.col(before) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")
    rank = F.when(able & (rank <= drawn), rank)
    joined = sorted_.join(F.broadcast(starts), part == starts["_part"])
    return joined.select(*[sorted_[c] for c in columns], F.col(name).withField("rank", rank).alias(name))


def drawn(docs, target, percent=PERCENT):
    """The drawn documents, all columns, in the order of their ranks within each partition."""
    name = free_name(docs, "resampling")
    return ranked(docs, target, name=name, percent=percent).where(F.col(name)["rank"].isNotNull()).select(*docs.columns)


def report(docs, target):
    """doc_id, n_features, weight, score, rank of every row of ``docs``."""
    rows = ranked(docs.select("doc_id", "text"), target, ["doc_id"])
    return rows.select("doc_id", *[f"resampling.{c}" for c in ("n_features", "weight", "score", "rank")])


# The steps of crc32 come from its fixed polynomial 0xEDB88320; each byte of a feature takes one.
REPORT_SQL = r"""
WITH RECURSIVE nibble AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM nibble WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS step FROM nibble WHERE k = 8),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(translate(text,
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
df AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
names AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, CAST(length(x) // 2 AS BIGINT)),
               lambda j: CAST('0x' || x[2 * j + 1:2 * j + 2] AS BIGINT))),
               lambda c, v: xor(step[(xor(c, v) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM names, crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket),
whole AS (SELECT (SELECT count(*) FROM df) AS s_all, (SELECT count(*) FROM bf) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)::DOUBLE /
             ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)::DOUBLE))) AS BIGINT) AS g FROM s FULL JOIN t USING (bucket), whole),
wt AS (SELECT row_id, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY row_id),
sc AS (SELECT row_id, doc_id, len(w) AS words, CAST(greatest(2 * len(w) - 1, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
           / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN wt USING (row_id)),
rk AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row_id) AS rank, count(*) OVER () AS n FROM sc WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM sc LEFT JOIN rk USING (row_id)
"""
