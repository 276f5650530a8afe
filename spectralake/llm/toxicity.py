"""Toxicity by a classifier chain of linear models.

Categories are predicted in order. Each has a logistic model over the words of the whole
text (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased, each distinct word once,
hashed) and over the probabilities of all categories before it. In training those come
from models that did not see the row (out of fold); in use from the models of all rows.

The models are fitted on at most ``TRAIN_ROWS`` labelled ids, those of smallest id hash, two
rows an id, and of a text longer than ``TRAIN_RUN`` characters a run anywhere in it;
words in fewer than ``LEAST_DOCS`` of them, or about as common among positives as at large, have
no weight. Scoring covers every row.

Null texts and texts without words have probability 0 in each category. A label that is
null leaves its row out of that category's model; a doc_id with several label rows counts
as positive if one is. A category without both outcomes among the labels has probability
equal to the share of positives. Repeated rows are scored each; other columns stay.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectralake.llm import text as T
from spectralake.llm.tables import sampled
from spectralake.storage import save

TRAIN_ROWS = 6000
TRAIN_RUN = 1 << 13     # characters of a text
LEAST_DOCS = 8
LEAST_Z = 4.5           # deviations from chance that give a word a weight
FOLDS = 3
BITS = 18
ROUNDS = 400
# category: the condition on the labels that makes a row positive
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
THRESHOLD = 0.5


def _distinct(data, offsets):
    """(text, word number) pairs of a block, each once, in order.

    Beside its words a text has a word for each share of different words, of capitals, of
    signs, of line ends and for its mean word length, in steps.
    """
    hashes, doc, starts, ends = T.word_hashes(data, offsets, T.ALNUM)
    n = len(offsets) - 1
    words, size = np.bincount(doc, minlength=n), np.maximum(np.diff(offsets), 1)
    different = np.bincount(np.unique((doc.astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32))).astype(np.int64) >> 32, minlength=n)
    sum_of = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
    upper, blank = sum_of((data >= 0x41) & (data <= 0x5A)), sum_of(~T.NOT_SPACE[data])
    lines, inside = sum_of(data == 0x0A), np.bincount(doc, ends - starts, n)
    look = [different / np.maximum(words, 1), upper / size, (size - inside - blank) / size, lines / np.maximum(words, 1), inside / np.maximum(words, 1) / 20]
    some = np.flatnonzero(words)
    for i, share in enumerate(look):
        doc = np.concatenate([doc, some])
        cell = np.digitize(share[some], [0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9]) + 100 * (i + 1)
        hashes = np.concatenate([hashes, T.mix(cell.astype(np.uint64) + T.PLACES[17])])
    pairs = np.unique((doc.astype(np.uint64) << np.uint64(BITS)) | (hashes >> np.uint64(64 - BITS)))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


class Rows:
    """Training rows as word numbers, one run for each row."""

    def __init__(self, texts):
        parts = [(lo, *_distinct(data, offsets)) for lo, _, data, offsets in T.blocks(pa.array(texts, pa.large_string()))]
        self.n = len(texts)
        self.row = np.concatenate([lo + doc for lo, doc, _ in parts])
        words = np.concatenate([w for _, _, w in parts])
        uses = np.bincount(words, minlength=1 << BITS)
        kept = uses[words] >= LEAST_DOCS
        self.row, words = self.row[kept], words[kept]
        self.names, self.word = np.unique(words, return_inverse=True)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(rows, extra, labels, used, rounds=ROUNDS, rate=0.15, decay=5e-5):
    """(word weights, weights of ``extra``, bias) of a logistic model on the rows ``used``; by Adam."""
    mine = used[rows.row]
    row, word = rows.row[mine], rows.word[mine]
    n, y = used.sum(), labels[used]
    share = y.mean() if n else 0.0
    if not n or share in (0.0, 1.0):
        return np.zeros(len(rows.names)), np.zeros(extra.shape[1]), float(_logit(share))
    # words whose share of positives is chance have no say: what is left generalises
    uses, hits = np.bincount(word, minlength=len(rows.names)), np.bincount(word, labels[row], len(rows.names))
    telling = np.abs(hits - uses * share) >= LEAST_Z * np.sqrt(np.maximum(uses, 1) * share * (1 - share))
    row, word = row[telling[word]], word[telling[word]]
    value = [np.zeros(len(rows.names)), np.zeros(extra.shape[1]), np.array([_logit(share)])]
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in value]
    for turn in range(1, rounds + 1):
        score = np.bincount(row, value[0][word], rows.n) + extra @ value[1] + value[2]
        wrong = np.where(used, _sigmoid(score) - labels, 0) / n
        gradients = [np.bincount(word, wrong[row], len(value[0])) + decay * value[0], extra.T @ wrong + decay * value[1], np.array([wrong.sum()])]
        for v, g, (m, s) in zip(value, gradients, state):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.99 ** turn)) + 1e-9)
    return value[0], value[1], float(value[2][0])


def _score(rows, extra, model):
    return np.bincount(rows.row, model[0][rows.word], rows.n) + extra @ model[1] + model[2]


def train(examples, folds=FOLDS):
    """Models of the chain from (text, fold number, label of each category or None) rows.

    Returns one (weights by word number, weights of earlier categories, bias) each.
    """
    if not examples:
        return []
    rows = Rows([e[0] for e in examples])
    fold = np.array([e[1] for e in examples]) % folds
    extra, models = np.zeros((rows.n, 0)), []
    for c in range(len(examples[0][2])):
        known = np.array([e[2][c] is not None for e in examples])
        labels = np.array([float(e[2][c] or 0) for e in examples])
        model = fit(rows, extra, labels, known)
        table = np.zeros(1 << BITS)
        table[rows.names] = model[0]
        models.append((table.astype(np.float32), model[1], model[2]))
        apart = np.zeros(rows.n)
        for k in range(folds):
            apart = np.where(fold == k, _score(rows, extra, fit(rows, extra, labels, known & (fold != k))), apart)
        extra = np.column_stack([extra, _logit(_sigmoid(apart))])
    return models


def training_rows(docs, labels, chain=CHAIN, most=TRAIN_ROWS):
    """(text, fold, labels) of at most ``most`` labelled ids with a text; rows of an id and lengths are bounded by ``sampled``."""
    targets = [F.max(F.expr(e)).cast("double").alias(f"y{i}") for i, (_, e) in enumerate(chain)]
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*targets).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = save(known.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 16))))
    rows = sampled(docs, known.select("doc_id"), characters=TRAIN_RUN).join(F.broadcast(known), "doc_id")
    found = rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return [(r["text"], r["fold"], [r[f"y{i}"] for i in range(len(chain))]) for r in found.to_pylist()]


def predict(docs, models, chain=CHAIN, name="toxicity"):
    """``docs`` with struct column ``name`` (p_<category> ...); all other columns stay."""
    names = [f"p_{name}" for name, _ in chain]

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_text"))
            out = np.zeros((len(names), len(batch)))
            for lo, hi, data, offsets in T.blocks(column) if models else ():
                doc, word = _distinct(data, offsets)
                n = hi - lo
                some = np.bincount(doc, minlength=n) > 0
                extra = np.zeros((n, 0))
                for c, (table, earlier, bias) in enumerate(models):
                    score = np.bincount(doc, table[word], n) + extra @ earlier + bias
                    out[c, lo:hi] = np.where(some, _sigmoid(score), 0)
                    extra = np.column_stack([extra, _logit(_sigmoid(score))])
            kept = batch.select([f for f in batch.schema.names if f != "_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, out)], [*kept.schema.names, *names])

    plain = docs.select([docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)] + [docs["text"].alias("_text")])
    fields = ", ".join([f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes)] + [f"{n} double" for n in names])
    done = plain.mapInArrow(run, fields)
    return done.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)] + [F.struct(*names).alias(name)])


def report(docs, labels, threshold=THRESHOLD):
    """doc_id, p_low_quality, p_toxic, toxic of every row of ``docs``."""
    rows = predict(docs.select("doc_id", "text"), train(training_rows(docs, labels)))
    return rows.select("doc_id", *[f"toxicity.p_{name}" for name, _ in CHAIN], (F.col("toxicity.p_toxic") >= threshold).alias("toxic"))
