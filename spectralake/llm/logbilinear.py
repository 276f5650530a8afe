"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, and one end
after them. Token counts of all training documents are a table in Spark; it has no bound.
The most frequent ``CLASSES`` words, the end and "other" are the classes of the model. It
predicts a vector from the vectors of the ``CONTEXT`` classes before, each by its own
matrix; a class's score is that vector's product with the class's own one plus a bias. A
text begins as if ends stood before it. Log-probabilities of classes are normalised over
all classes by batched matrix products, one row for each distinct context. A word of the
class "other" has the class's probability times its share in it, which is that of its
smoothed count, with one share left for words never seen; so probabilities sum to 1.

Training tells a batch's tokens from noise drawn from the classes' shares, shared within
the batch; nothing is normalised there. All training documents take part, each once: they
are dealt to ``ROUNDS`` of growing size by hash. In a round every task starts from the same
weights, learns from all its documents and gives its weights back in slices; slices are
averaged by tokens, and the mean starts the next round. Weights follow how Spark cuts the
table into tasks: the same cut gives the same model but for rounding.

Scoring: the counts of the ``SHIPPED`` most frequent words go to every task (words over
``WORD_BYTES`` bytes as a digest, which bounds their size). All other words are listed by
document and meet the count table in a join, whose keys are rare by construction.

Null texts are empty: one end. Rows with a null doc_id are learned from and not held out.
Repeated rows are learned from and scored each. Without training documents only "end" and
"other" are known, equally likely. Empty tables give no rows. Long texts are split piece by
piece. Other columns stay out of the way.
"""

import hashlib
import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from spectralake.llm import text as T
from spectralake.llm.tables import free_name
from spectralake.storage import save

CLASSES = 1024
SHIPPED = 1 << 17
WORD_BYTES = 64
CONTEXT = 2
SIZE = 32
NOISE = 64              # noise classes of a batch
BATCH = 1024
RATE = 0.1
ROWS = 64               # of a matrix product; larger ones would start threads of their own within a task
POOL = 1 << 18          # tokens that are shuffled among each other
ROUNDS = (1, 4, 16)     # of the 16 equal lots of training documents, up to which one each round goes
SLICES = 16             # of the weights
FLUSH = 1 << 18         # distinct words that a task counts before it hands them on
SMOOTH = 0.1
CHUNK = 1 << 16         # tokens scored at once
LOWER = bytes(T.LOWER)


def held_out(doc_id):
    """True for documents that training must not see: crc32 of the id's text is divisible by 10."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def words_of(raw):
    """Lists of the words of a text's bytes, piece by piece; long words as digests."""
    for piece in T.pieces(raw):
        words = piece.translate(LOWER).split()
        if words and max(map(len, words)) > WORD_BYTES:
            words = [w if len(w) <= WORD_BYTES else b"\x00" + hashlib.sha256(w).digest() for w in words]
        yield words


def count_words(docs):
    """(word, c) over all rows of ``docs``; tasks add up what they meet before it is shuffled."""
    def run(batches):
        found = Counter()

        def handed():
            rows = pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])
            found.clear()
            return rows

        for batch in batches:
            for raw in T.raw_texts(batch.column(0)):
                for words in words_of(raw):
                    found.update(words)
                    if len(found) > FLUSH:
                        yield handed()
        yield handed()

    rows = docs.select("text").mapInArrow(run, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts, most=SHIPPED):
    """At most ``most`` (word, c) of highest counts, most frequent first.

    Words are taken by bands of counts (an eighth of a doubling each) and, in the last one
    that fits only partly, by hash; nothing is sorted in one task.
    """
    band = F.floor(F.log2("c") * 8) * 256 + F.pmod(F.xxhash64("word"), F.lit(256))
    rows, least = 0, None
    for r in counts.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():     # some 100,000 rows at the very most
        rows += r["count"]
        if rows > most:
            break
        least = r["band"]
    if least is None:
        return []
    return sorted(((bytes(r["word"]), r["c"]) for r in counts.where(band >= least).collect()), key=lambda r: (-r[1], r[0]))


class Weights:
    """What training changes: context vectors, class vectors, context matrices, biases."""

    def __init__(self, share, size=SIZE, seed=5):
        draw = np.random.default_rng(seed)
        n = len(share)
        self.shapes = [(n, size), (n, size), (CONTEXT, size, size), (n,)]
        self.parts = [draw.normal(0, 0.1, (n, size)), draw.normal(0, 0.1, (n, size)),
                      np.stack([np.eye(size)] * CONTEXT), np.log(share)]
        self.parts = [p.astype(np.float32) for p in self.parts]

    def flat(self):
        return np.concatenate([p.ravel() for p in self.parts])

    def filled(self, flat):
        """These weights with the values of ``flat``."""
        other = object.__new__(Weights)
        ends = np.cumsum([math.prod(s) for s in self.shapes])
        other.shapes = self.shapes
        other.parts = [p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends[:-1]), self.shapes)]
        return other


def _blocks(a):
    """``a`` in blocks of ``ROWS`` rows, the last one filled up with zeros."""
    n = -len(a) % ROWS
    return (np.concatenate([a, np.zeros((n, a.shape[1]), a.dtype)]) if n else a).reshape(-1, ROWS, a.shape[1])


def _times(a, b):
    """``a @ b`` by blocks."""
    return (_blocks(a) @ b).reshape(-1, b.shape[1])[:len(a)]


def _across(a, b):
    """``a.T @ b`` by blocks."""
    return (_blocks(a).transpose(0, 2, 1) @ _blocks(b)).sum(0)


def _sigmoid(x):
    """The logistic function, in the place of ``x``."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Learner:
    """Adagrad on the noise-contrastive loss, from given weights."""

    def __init__(self, weights, share, seed):
        self.weights = weights.filled(weights.flat())
        self.draw = np.random.default_rng(seed)
        self.upto = np.cumsum(share) / share.sum()
        self.offset = np.log(NOISE * share).astype(np.float32)
        self.seen = [np.full(p.shape, 1e-3, np.float32) for p in self.weights.parts]
        self.tokens, self.pool, self.pooled = 0, [], 0

    def add(self, before, ids):
        """Learn from tokens ``ids`` after the classes ``before``, some time."""
        self.pool.append((before, ids))
        self.pooled += len(ids)
        if self.pooled >= POOL:
            self.learn()

    def learn(self):
        if not self.pool:
            return
        before, ids = (np.concatenate(x) for x in zip(*self.pool))
        order = self.draw.permutation(len(ids))
        for at in range(0, len(ids), BATCH):
            some = order[at:at + BATCH]
            self.step(before[some], ids[some])
        self.tokens += len(ids)
        self.pool, self.pooled = [], 0

    def step(self, before, ids):
        vectors, classes, matrices, bias = self.weights.parts
        noise = np.minimum(np.searchsorted(self.upto, self.draw.random(NOISE), "right"), len(bias) - 1)
        context = [vectors[before[:, j]] for j in range(CONTEXT)]
        x = sum(_times(c, m) for c, m in zip(context, matrices))
        own, false, lead = classes[ids], classes[noise], bias - self.offset
        right = (_sigmoid(np.einsum("ij,ij->i", x, own) + lead[ids]) - 1) / len(ids)
        wrong = _sigmoid(_times(x, false.T) + lead[noise]) / len(ids)
        dx = _times(wrong, false)
        dx += own * right[:, None]
        slopes = [_across(c, dx) for c in context]
        before_slope = np.concatenate([_times(dx, m.T) for m in matrices])
        self.change(1, np.concatenate([ids, noise]), np.concatenate([x * right[:, None], _across(wrong, x)]))
        self.change(0, before.T.ravel(), before_slope)
        by_bias = np.bincount(ids, right, len(bias)) + np.bincount(noise, wrong.sum(0), len(bias))
        for part, slope in ((2, np.stack(slopes)), (3, by_bias.astype(np.float32))):
            self.seen[part] += slope ** 2
            self.weights.parts[part] -= RATE * slope / np.sqrt(self.seen[part])

    def change(self, part, ids, slopes):
        """Step the rows ``ids`` of a part, whose slopes are added up by row first."""
        order = np.argsort(ids, kind="stable")
        names = ids[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        names, slope = names[first], np.add.reduceat(slopes[order], first, axis=0)
        seen = self.seen[part][names] + slope * slope
        self.seen[part][names] = seen
        self.weights.parts[part][names] -= RATE * slope / np.sqrt(seen)


def _contexts(ids, end):
    """The classes before each token of a text, (n, CONTEXT), the nearest first."""
    padded = np.concatenate([np.full(CONTEXT, end, np.int32), ids])
    return np.stack([padded[CONTEXT - 1 - j:len(padded) - 1 - j] for j in range(CONTEXT)], 1)


def _ids(raw, get, other, end):
    """The class of each token of a text's bytes, the end last."""
    parts = [np.fromiter(map(get, words, repeat(other)), np.int32, len(words)) for words in words_of(raw)]
    return np.concatenate([*parts, np.array([end], np.int32)])


class Model:
    """Counts, classes and weights. ``counts`` is the saved table of all training words."""

    def __init__(self, counts, n_docs, classes=CLASSES, shipped=SHIPPED):
        self.counts, self.ends = counts, n_docs
        whole = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
        self.tokens = (whole["n"] or 0) + n_docs
        self.distinct = whole["v"] + (n_docs > 0)
        self.shipped = frequent(counts, shipped)
        self.n = min(classes, len(self.shipped))
        self.end, self.other = self.n, self.n + 1
        known = [c for _, c in self.shipped[:self.n]] + [n_docs]
        per_class = np.array([*known, self.tokens - sum(known)], float) + SMOOTH
        self.share = per_class / per_class.sum()
        self.weights = Weights(self.share)
        # logarithms of what smoothed counts are divided by
        self.base_whole = math.log10(self.tokens + SMOOTH * (self.distinct + 1))
        self.other_whole = math.log10(self.tokens - sum(known) + SMOOTH * (whole["v"] - self.n) + SMOOTH)


def _mean(rows):
    """(slice, values): token-weighted means of the slices that tasks gave back, added up as they arrive."""
    def run(batches):
        sums, weights = {}, Counter()
        for batch in batches:
            for name, tokens, values in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums[name] = sums.get(name, 0) + tokens * np.frombuffer(values, np.float32).astype(float)
                weights[name] += tokens
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([(sums[k] / weights[k]).tobytes() for k in names], pa.binary())], ["slice", "values"])

    return rows.repartition(SLICES, "slice").mapInArrow(run, "slice int, values binary")


def train(docs, classes=CLASSES, shipped=SHIPPED, rounds=ROUNDS, seed=5):
    """A model of all rows of ``docs``."""
    model = Model(save(count_words(docs)), docs.count(), classes, shipped)
    classes = {w: i for i, (w, _) in enumerate(model.shipped[:model.n])}
    share, end, other = model.share, model.end, model.other
    lot, lower = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(rounds[-1])), 0
    for turn, upper in enumerate(rounds):
        start = model.weights

        def run(batches, start=start, turn=turn):
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            learner = Learner(start, share, (seed, turn, part))
            for batch in batches:
                for raw in T.raw_texts(batch.column(0)):
                    ids = _ids(raw, classes.get, other, end)
                    learner.add(_contexts(ids, end), ids)
            learner.learn()
            if learner.tokens:
                slices = [s.tobytes() for s in np.array_split(learner.weights.flat(), SLICES)]
                yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([learner.tokens] * SLICES, pa.int64()), pa.array(slices, pa.binary())],
                                                 ["slice", "tokens", "values"])

        some = docs.where((lot >= lower) & (lot < upper)).select("text")
        found = {r["slice"]: np.frombuffer(r["values"]) for r in _mean(some.mapInArrow(run, "slice int, tokens long, values binary")).collect()}
        if found:
            model.weights = start.filled(np.concatenate([found[k] for k in range(SLICES)]))
        lower = upper
    return model


class Scorer:
    """Normalised log-probabilities of classes, in batches; what normalises a context is kept."""

    def __init__(self, weights):
        vectors, self.classes, matrices, self.bias = weights.parts
        self.moved = [_times(vectors, m) for m in matrices]
        self.n = len(self.bias)
        # classes in blocks, too; what fills up the last one has no probability
        more = -self.n % (2 * ROWS)
        filled = np.concatenate([self.classes, np.zeros((more, self.classes.shape[1]), np.float32)])
        self.by_block = filled.reshape(-1, 2 * ROWS, filled.shape[1]).transpose(0, 2, 1)
        self.block_bias = np.concatenate([self.bias, np.full(more, -np.inf, np.float32)]).reshape(-1, 1, 2 * ROWS)
        self.whole = np.full(self.n ** CONTEXT, np.nan, np.float32)

    def predicted(self, keys):
        x = 0
        for j in range(CONTEXT):
            x = x + self.moved[j][keys // self.n ** (CONTEXT - 1 - j) % self.n]
        return x

    def chunk(self, before, ids):
        keys = np.zeros(len(ids), np.int64)
        for j in range(CONTEXT):
            keys = keys * self.n + before[:, j]
        distinct, which = np.unique(keys, return_inverse=True)
        new = distinct[np.isnan(self.whole[distinct])]
        for at in range(0, len(new), 2048):
            some = new[at:at + 2048]
            scores = _blocks(self.predicted(some))[:, None] @ self.by_block + self.block_bias
            top = scores.max((1, 3), keepdims=True)
            scores -= top
            whole = top[:, 0, :, 0] + np.log(np.exp(scores, out=scores).sum((1, 3)))
            self.whole[some] = whole.ravel()[:len(some)]
        own = np.einsum("ij,ij->i", self.predicted(distinct)[which], self.classes[ids]) + self.bias[ids]
        return own.astype(float) - self.whole[distinct][which]

    def __call__(self, before, ids):
        parts = [self.chunk(before[a:a + CHUNK], ids[a:a + CHUNK]) for a in range(0, len(ids), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0)


def scored(docs, model, columns=None, name="lm"):
    """``columns`` (all, if None) of every row of ``docs`` with struct ``name``: n_tokens, n_known, base_score, score."""
    columns = docs.columns if columns is None else columns
    place = {w: i for i, (w, _) in enumerate(model.shipped)}
    logs = np.log10(np.array([c for _, c in model.shipped], float) + SMOOTH)
    weights, n, end, other, ends = model.weights, model.n, model.end, model.other, model.ends
    base_whole, other_whole = model.base_whole, model.other_whole

    def run(batches):
        scorer = Scorer(weights)

        def measured(texts):
            """Rows (tokens, known, base, score, rare words) of a few texts, together."""
            found, rare = [], []
            for raw in texts:
                missing = Counter()
                parts = []
                for words in words_of(raw):
                    ids = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
                    missing.update(words[i] for i in np.flatnonzero(ids < 0))
                    parts.append(ids)
                found.append(np.concatenate([*parts, np.array([-2], np.int32)]))
                rare.append(missing)
            classes = [np.where(ids == -2, end, np.where((ids < 0) | (ids >= n), other, ids)).astype(np.int32) for ids in found]
            log = scorer(np.concatenate([_contexts(c, end) for c in classes]), np.concatenate(classes)) / math.log(10)
            at = 0
            for ids, some in zip(found, rare):
                inside = ids[ids >= 0]
                further = inside[inside >= n]
                total = log[at:at + len(ids)].sum() + logs[further].sum() - other_whole * (len(further) + sum(some.values()))
                base = logs[inside].sum() + math.log10(ends + SMOOTH) - base_whole * len(ids)
                yield len(ids), len(inside) + (ends > 0), float(base), float(total), list(some.items())
                at += len(ids)

        for batch in batches:
            rows, some, size = [], [], 0
            for raw in T.raw_texts(batch.column(batch.schema.get_field_index("_text"))):
                some.append(raw)
                size += len(raw)
                if size > T.BLOCK:
                    rows += measured(some)
                    some, size = [], 0
            rows += measured(some) if some else []
            kept = batch.select([f for f in batch.schema.names if f != "_text"])
            tokens, known, base, total, rare = zip(*rows) if rows else ((),) * 5
            kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            rare = pa.array([[{"word": w, "n": k} for w, k in r] for r in rare], kind)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), rare],
                [*kept.schema.names, "_tokens", "_known", "_base", "_score", "_rare"])

    types = dict(docs.dtypes)
    plain = docs.select([docs[c].alias(f"c{i}") for i, c in enumerate(columns)] + [docs["text"].alias("_text")])
    fields = "".join(f"c{i} {types[c]}, " for i, c in enumerate(columns))
    rows = plain.mapInArrow(run, f"{fields}_tokens long, _known long, _base double, _score double, _rare array<struct<word:binary,n:bigint>>")
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()))
    words = rows.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.n")
    met = words.join(model.counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("_logs"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_more"))
    rows = rows.drop("_rare").join(met, "_row", "left")
    logs_of = F.coalesce("_logs", F.lit(0.0))
    return rows.select([F.col(f"c{i}").alias(c) for i, c in enumerate(columns)] + [F.struct(
        F.col("_tokens").alias("n_tokens"), (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        (F.col("_base") + logs_of).alias("base_score"), (F.col("_score") + logs_of).alias("score")).alias(name)])


def least_perplexed(docs, model, most):
    """The rows of ``docs`` whose mean log10 probability a token is at least ``-most``; all columns stay."""
    name = free_name(docs, "lm")
    return scored(docs, model, name=name).where(F.col(name)["score"] >= -most * F.col(name)["n_tokens"]).select(*docs.columns)


def report(docs):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text"))
    rows = scored(docs.select("doc_id", "text"), model, ["doc_id"])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lm.n_tokens", "lm.n_known",
                       F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")
