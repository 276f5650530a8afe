"""Language of every whole text by a linear-chain conditional random field over its words.

A word's features are the 2- to 4-grams of its UTF-8 letters with a boundary at both
ends (those at the ends are its affixes) and the word itself as lexicon entry, all hashed
into tables of fixed size. Forward-backward gives each word the probability of each
language given all other words, so words are labelled also where a text changes language.
A text's language is the one with the highest mean probability over its words, ties to
the first in order, and that mean is its score. How sure the words are is another measure: the mean
probability of each word's own best language. A text of several languages, each certain,
has a low score and sure words; ``known`` keeps it.

Training reads the texts of at most ``TRAIN_DOCS`` ids of each language, those of smallest
hash, from rows that are given as training rows: two rows an id, and of a text longer than
``TRAIN_RUN`` characters a run of that length that begins anywhere in it. Of these, texts
are taken until ``TRAIN_WORDS`` words of each language are there; only they become
features. Their words are cut into runs of 8 to 40 and shuffled into mixed sequences so
that transitions between languages are learned.

Null texts and texts without a letter are ``und`` with score 0; a letter is there what
``str.isalpha`` says. Words are cut at ASCII characters that are no letters; whatever lies
beyond ASCII joins to a word, and lower-casing reaches ASCII and Latin-1. Nothing but
the text enters a prediction; other columns stay. No training row: all are ``und``.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from spectralake.llm import crf
from spectralake.llm import text as T
from spectralake.llm.tables import free_name, sampled

TRAIN_DOCS = 250
TRAIN_RUN = 1 << 12     # characters of a text
TRAIN_WORDS = 60_000    # words of each language taken from them
GRAMS = 1 << 16
WORDS = 1 << 16
UNKNOWN = "und"


def _letters(data):
    """Lower-cased bytes with blanks for what is not a letter (ASCII and Latin-1)."""
    data = T.LOWER[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    data[(data < 0x61) | ((data > 0x7A) & (data < 0x80))] = 0x20
    return data


def _features(data, starts, ends):
    """(feature ids, word number of each, rows) of the given words of letter bytes."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    # each word as its bytes between two blanks, all in one buffer
    heads = np.cumsum(sizes + 2) - (sizes + 2)
    buffer = np.full(int((sizes + 2).sum()) + 3, 0x20, np.uint64)
    word = np.repeat(np.arange(n), sizes)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    buffer[heads[word] + 1 + inside] = data[starts[word] + inside]
    owner = np.repeat(np.arange(n), sizes + 2)
    place = np.arange(len(owner)) - heads[owner]
    ids, owners = [], []
    code = buffer.copy()
    for width in (2, 3, 4):
        code[:-(width - 1)] = code[:-(width - 1)] * np.uint64(256) + buffer[width - 1:]
        fits = place + width <= sizes[owner] + 2
        ids.append((T.mix(code[:len(owner)][fits] + T.PLACES[width]) & np.uint64(GRAMS - 1)).astype(np.int64))
        owners.append(owner[fits])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


class _Words:
    """Words of a block, with features of each distinct one."""

    def __init__(self, data, offsets):
        letters = _letters(data)
        self.starts, self.ends, self.doc = T.word_bounds(letters, offsets, T.NOT_SPACE)
        hashes = T.hash_spans(letters, self.starts, self.ends)
        self.hashes, first, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        self.ids, self.owners = _features(letters, self.starts[first], self.ends[first])
        self.entry = (GRAMS + (self.hashes & np.uint64(WORDS - 1))).astype(np.int64)

    def scores(self, weights):
        """Emission scores of the distinct words: the mean of their grams and the entry."""
        if not len(self.entry):
            return np.zeros((0, weights.shape[1]))
        bounds = np.searchsorted(self.owners, np.arange(len(self.entry)))
        sums = np.add.reduceat(weights[self.ids], bounds, axis=0)
        return 4 * sums / np.bincount(self.owners, minlength=len(self.entry))[:, None] + weights[self.entry]


def train(rows, seed=7):
    """A model from (text, lang) pairs: languages, weights, transitions."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    random = np.random.default_rng(seed)
    left, few = dict.fromkeys(languages, TRAIN_WORDS), []
    for i in random.permutation(len(rows)):
        text, lang = rows[i]
        if left[lang] > 0:
            left[lang] -= len(text.split())
            few.append((text, lang))
    rows = few
    texts = pa.array([text for text, _ in rows], pa.large_string())
    code = np.array([languages.index(lang) for _, lang in rows])
    data, offsets = T.strings(texts)
    words = _Words(data, offsets)
    label = code[words.doc]
    runs = []
    for doc in range(len(rows)):
        at, end = np.searchsorted(words.doc, [doc, doc + 1])
        while at < end:
            size = int(random.integers(8, 41))
            runs.append((at, min(end, at + size)))
            at += size
    random.shuffle(runs)
    kept, left = [], {c: TRAIN_WORDS for c in range(len(languages))}
    for at, end in runs:
        if left[label[at]] > 0:
            left[label[at]] -= end - at
            kept.append(np.arange(at, end))
    if not kept:
        return None
    picked = np.concatenate(kept)
    which, label = words.which[picked], label[picked]
    lengths = [200] * (len(picked) // 200) + ([len(picked) % 200] if len(picked) % 200 else [])
    grams = np.bincount(words.owners, minlength=len(words.entry))
    k = len(languages)

    def spread(gradient):
        by_word = np.stack([np.bincount(which, gradient[:, c], len(words.entry)) for c in range(k)], 1)
        share = (4 * by_word / grams[:, None])[words.owners]
        every = np.stack([np.bincount(words.ids, share[:, c], GRAMS + WORDS) + np.bincount(words.entry, by_word[:, c], GRAMS + WORDS)
                          for c in range(k)], 1)
        return every

    weights, trans = crf.fit(lambda w: words.scores(w)[which], spread, GRAMS + WORDS, label, lengths, k, rounds=25, rate=0.15)
    return languages, weights.astype(np.float32), trans


def training_rows(docs, most=TRAIN_DOCS):
    """(text, lang) of the rows of at most ``most`` ids of each language, by hash; bounded by ``sampled``."""
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = docs.where("lang is not null and text is not null and doc_id is not null").select(
        "lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("lang", "doc_id")
    return sorted((r["text"], r["lang"]) for r in sampled(docs, ids, characters=TRAIN_RUN).collect())


def word_labels(model, texts):
    """For tests and users of the model: (word, language, probability) lists of texts."""
    languages, weights, trans = model
    result = []
    for text in texts:
        data, offsets = T.strings(pa.array([text], pa.large_string()))
        words = _Words(data, offsets)
        marginals = crf.forward_backward(words.scores(weights)[words.which].astype(float), trans, [len(words.which)])[0]
        result.append([(bytes(_letters(data)[s:e]).decode(errors="replace"), languages[int(m.argmax())], float(m.max()))
                       for s, e, m in zip(words.starts, words.ends, marginals)])
    return result


def predict(docs, model, name="language"):
    """``docs`` with struct column ``name``: lang_pred, score, sure; all other columns stay."""
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_text"))
            names, scores, sure = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            for lo, hi, data, offsets in T.blocks(column) if model else ():
                languages, weights, trans = model
                words = _Words(data, offsets)
                n = hi - lo
                counts = np.bincount(words.doc, minlength=n)
                marginals = crf.forward_backward(words.scores(weights)[words.which].astype(float), trans, counts)[0]
                sums = np.stack([np.bincount(words.doc, marginals[:, c], n) for c in range(len(languages))], 1)
                tops = np.bincount(words.doc, marginals.max(1), n) if len(marginals) else np.zeros(n)
                letter = np.bincount(words.doc, (data[words.starts] < 0x80), n) > 0
                best = sums.argmax(1)
                for i in np.flatnonzero(counts):
                    if letter[i] or any(c.isalpha() for c in column[lo + int(i)].as_py()):
                        names[lo + i] = languages[best[i]]
                        scores[lo + i] = min(1.0, sums[i, best[i]] / counts[i])
                        sure[lo + i] = min(1.0, tops[i] / counts[i])
            kept = batch.select([f for f in batch.schema.names if f != "_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(names), pa.array(scores), pa.array(sure)], [*kept.schema.names, "_lang", "_score", "_sure"])

    plain = docs.select([docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)] + [docs["text"].alias("_text")])
    fields = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    done = plain.mapInArrow(run, f"{fields}, _lang string, _score double, _sure double")
    return done.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)] + [
        F.struct(F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_sure").alias("sure")).alias(name)])


def held_out(doc_id):
    """True for rows that training must not see: crc32 of the id's text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs):
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    model = train(training_rows(docs.where(~held_out(F.col("doc_id")))))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def known(docs, least=0.5):
    """The rows of ``docs`` whose words' languages are found, this surely in the mean and in any mix; all columns stay."""
    model = train(training_rows(docs.where(~held_out(F.col("doc_id")))))
    name = free_name(docs, "language")
    rows = predict(docs, model, name).where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["sure"] >= least))
    return rows.select(*docs.columns)
