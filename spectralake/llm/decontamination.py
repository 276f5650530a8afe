"""Benchmark decontamination by a positional inverted index, in built-in expressions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A
window is ``width`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window. A match is an exact occurrence of a window in a document.

1. Document frequencies of the benchmark's words are counted over all documents.
2. Every window names its ``PROBES`` rarest places; the postings (term, document, place)
   of the words there are stored as a table. Other words need no postings.
3. Postings meet the items' places of the same term; the difference of both places is
   the alignment. Counting by (document, item, alignment) intersects all offset-adjusted
   lists at once: an alignment with fewer places met than a window has probes holds no
   window.
4. The windows of the other alignments are compared word by word in the document's text.

Null texts have no words. Benchmark rows without an item_id are ignored, those of one
item_id (of any type) are one item with the windows of each text. Rows are told apart by
id and text, so documents with repeated or null ids have lists of their own. Other columns
stay out of the way; empty tables give no matches.
"""

from pyspark.sql import functions as F

from spectralake.llm.tables import bounded, free_name
from spectralake.storage import save

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 10
PROBES = 3


def exact_words(text):
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, GAP), lambda w: w != "")


def items_of(benchmark):
    """(item, item_id, words) of each distinct item text with words."""
    rows = benchmark.where("item_id is not null").select("item_id", exact_words(F.col("text")).alias("words")).distinct()
    return rows.where(F.size("words") > 0).select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def frequencies(docs, items):
    """(term, n): how often each word of the items occurs in all documents."""
    terms = save(items.select(F.explode("words").alias("term")).distinct())
    words = docs.select(F.explode(exact_words(F.col("text"))).alias("term"))
    counts = words.join(bounded(terms, 64), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def windows_of(items, counts, width=WIDTH, probes=PROBES):
    """``items`` with windows: an array of (at, length, probes), probes being places in the item."""
    places = items.select("item", F.posexplode("words").alias("place", "term")).join(bounded(counts, 64), "term")
    rare = places.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("rare"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0)))
    length = F.least(F.size("words"), F.lit(width))

    def window(at):
        span = F.array_sort(F.transform(F.slice("rare", at + 1, length), lambda x: F.struct(x["n"].alias("n"), x["place"].alias("place"))))
        return F.struct(at.alias("at"), length.alias("length"), F.transform(F.slice(span, 1, probes), lambda x: x["place"]).alias("probes"))

    return items.join(rare, "item").withColumn("windows", F.transform(starts, window)).drop("rare")


def postings(docs, terms):
    """The stored index: (term, doc_id, place) of each occurrence of ``terms``, a saved table."""
    words = docs.select("doc_id", F.posexplode(exact_words(F.col("text"))).alias("place", "term"))
    return save(words.join(bounded(terms, 64), "term").select("term", "doc_id", "place"))


def probes_of(windows):
    """(term, item, place, need): the distinct places of the items that windows probe.

    ``need`` is the fewest probes of a window of the item.
    """
    places = F.array_distinct(F.flatten(F.transform("windows", lambda w: w["probes"])))
    need = F.array_min(F.transform("windows", lambda w: F.size(w["probes"])))
    rows = windows.select("item", "words", need.alias("need"), F.explode(places).alias("place"))
    return rows.select(F.element_at("words", F.col("place") + 1).alias("term"), "item", "place", "need")


def alignments(index, probes):
    """(doc_id, item, shift): where enough probed places of an item lie at place + shift."""
    met = index.withColumnRenamed("place", "doc_place").join(bounded(probes, 96), "term")
    groups = met.groupBy("doc_id", "item", "need", (F.col("doc_place") - F.col("place")).alias("shift")).agg(F.count("*").alias("n"))
    return groups.where(F.col("n") >= F.col("need")).select("doc_id", "item", "shift")


def survivors(index, windows):
    """Windows (as item_id, at, words) of the alignments that are left, listed by document."""
    rows = alignments(index, save(probes_of(windows))).join(bounded(windows, 4096), "item")
    # a window begins inside the document
    kept = F.filter("windows", lambda w: w["at"] + F.col("shift") >= 0)
    listed = F.transform(kept, lambda w: F.struct(
        F.col("item_id").alias("item_id"), (w["at"] + F.col("shift")).alias("at"), F.slice("words", w["at"] + 1, w["length"]).alias("words")))
    return rows.groupBy("doc_id").agg(F.flatten(F.collect_list(listed)).alias("windows"))


def prepared(docs, benchmark, width=WIDTH, probes=PROBES):
    """(index, windows): the stored postings and the windows with their probes."""
    items = save(items_of(benchmark))
    counts = save(frequencies(docs, items))
    windows = save(windows_of(items, counts, width, probes))
    terms = save(probes_of(windows).select("term").distinct())
    return postings(docs, terms), windows


def phrase_matches(docs, benchmark, width=WIDTH, name="contamination"):
    """Every row of ``docs``, all columns, with ``name``: n_words and matches (item_id, at, length)."""
    # a hash that two rows share costs a look at each other's windows, no more
    row = F.xxhash64("doc_id", "text")
    index, windows = prepared(docs.select(row.alias("doc_id"), "text"), benchmark, width)
    key, listed = free_name(docs, "_id"), free_name(docs, "_windows")
    found = save(survivors(index, windows)).select(F.col("doc_id").alias(key), F.col("windows").alias(listed))
    rows = docs.join(bounded(found, 8192), row == F.col(key), "left")
    words = exact_words(F.col("text"))
    held = F.transform(F.array(words), lambda ws: F.filter(
        listed, lambda w: F.slice(ws, w["at"] + 1, F.size(w["words"])) == w["words"]))[0]
    matches = F.when(F.col(listed).isNotNull(), F.transform(held, lambda w: F.struct(
        w["item_id"].alias("item_id"), w["at"].alias("at"), F.size(w["words"]).alias("length"))))
    n_words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return rows.select(*[docs[c] for c in docs.columns], F.struct(n_words.alias("n_words"), matches.alias("matches")).alias(name))


def report(docs, benchmark, width=WIDTH):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    rows = phrase_matches(docs.select("doc_id", "text"), benchmark, width)
    none = F.array().cast(rows.schema["contamination"].dataType["matches"].dataType)
    matches = F.coalesce(F.col("contamination.matches"), none)
    hit = F.array_distinct(F.flatten(F.transform(matches, lambda m: F.sequence(m["at"], m["at"] + m["length"] - 1))))
    names = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"].cast("string"))))
    rows = rows.select("doc_id", F.col("contamination.n_words").alias("n_words"), F.size(hit).cast("long").alias("n_hit"), names.alias("names"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"),
                       F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs, benchmark, width=WIDTH):
    """The rows of ``docs`` without any match; all columns stay."""
    name = free_name(docs, "contamination")
    rows = phrase_matches(docs, benchmark, width, name)
    matched = F.coalesce(F.size(F.col(name)["matches"]) > 0, F.lit(False))
    return rows.where(~matched).select(*docs.columns)


def proximity_matches(index, windows, slop=5):
    """(doc_id, item_id, at, places): windows whose probes all lie within ``slop`` words of their place.

    ``at`` is the document place of the window's rarest probe. The probes keep no fixed
    order or distance, so reworded passages count; each further probe is looked up in
    cells of ``slop`` + 1 places, an equi-join, and then held to the exact distance.
    """
    one = windows.select("item_id", "words", F.explode("windows").alias("w"))
    one = one.select("item_id", F.col("w.at").alias("window"), F.transform("w.probes", lambda p: F.struct(
        F.element_at("words", p + 1).alias("term"), p.alias("place"))).alias("probes"))
    first = one.withColumns({"term": F.col("probes")[0]["term"], "place": F.col("probes")[0]["place"]})
    rows = first.join(index.withColumnRenamed("place", "at"), "term").select(
        "doc_id", "item_id", "window", "probes", "at", (F.col("at") - F.col("place")).alias("shift"), F.array("at").alias("places"))
    cell = slop + 1
    there = index.select(F.col("doc_id").alias("d"), F.col("term").alias("t"), F.col("place").alias("p"),
                         F.floor(F.col("place") / cell).alias("c"))
    for k in range(1, PROBES):
        wanted = F.col("probes")[k]["place"] + F.col("shift")
        near = rows.where(F.size("probes") > k).withColumn("cell", F.explode(F.array_distinct(F.transform(
            F.array(F.lit(-slop), F.lit(0), F.lit(slop)), lambda s: F.floor((wanted + s) / cell)))))
        met = near.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("probes")[k]["term"] == F.col("t")) & (F.col("cell") == F.col("c")))
        met = met.where(F.abs(F.col("p") - wanted) <= slop).groupBy("doc_id", "item_id", "window", "probes", "at", "shift", "places").agg(
            F.min(F.struct(F.abs(F.col("p") - wanted), "p")).alias("best"))
        met = met.withColumn("places", F.concat("places", F.array(F.col("best.p")))).drop("best")
        rows = rows.where(F.size("probes") <= k).unionByName(met)
    return rows.select("doc_id", "item_id", "at", "places").distinct()


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(regexp_extract_all(translate(text,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, words, least(len(words), 10) AS n FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, n, words[k + 1:k + n] AS gram FROM (SELECT *, unnest(range(len(words) - n + 1)) AS k FROM i)),
g AS (SELECT row_id, k, n, words[k + 1:k + n] AS gram FROM (
          SELECT d.*, l.n, unnest(range(len(words) - l.n + 1)) AS k FROM d JOIN (SELECT DISTINCT n FROM i) l ON len(words) >= l.n)),
m AS (SELECT g.row_id, g.k, g.n, w.item_id FROM g JOIN w ON g.n = w.n AND g.gram = w.gram),
h AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY row_id),
s AS (SELECT row_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (
          SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN s USING (row_id)
"""
