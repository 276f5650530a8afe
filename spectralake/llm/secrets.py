"""Secret scan: base patterns, and spans that a conditional random field adds.

Base spans, leftmost and not overlapping within a kind, found in whole texts; matches
that fail the length are dropped: ``assign`` (a key word, ``:`` or ``=``, a value of 6 or
more characters; the span is the whole match), ``access`` (``AKIA`` and capitals or
digits, 20 or more in all), ``hex`` (24 or more lower-case hexadecimal digits). Places
are code points, ends exclusive.

The field tags the tokens of a text as secret begin, inside or outside. Features: the
token's shape (length, kinds of characters, share of digits, changes between kinds), the
characters at its sides, its neighbours' words and shapes, and how the whole text looks.
Tags are decoded by Viterbi. Tokens whose outside score leads by more than any change of
transitions could win are outside in every best path, so decoding runs only on the
stretches between them; the result is that of the whole chain.
A begun run of tokens that meets no base span is a span of kind ``crf``.

The field learns from the base spans of at most ``TRAIN_DOCS`` texts (those of smallest id
hash) and from made-up secrets of many formats set into copies of them.

Null and empty texts have no spans. Repeated rows are scanned each. Other columns stay.
"""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectralake.llm import crf
from spectralake.llm import text as T
from spectralake.llm.tables import free_name, sampled

# Fixed patterns of the base kinds, in the order that sorts equal starts.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

TRAIN_DOCS = 400
TRAIN_RUN = 1 << 13     # characters of a text
FEATURES = 1 << 15
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

# Token bytes: all but blanks, quotes, brackets and separators.
TOKEN = T.NOT_SPACE.copy()
TOKEN[[ord(c) for c in "\"'`,;()[]{}<>|:=&*#$%!?"]] = False
_KIND = np.zeros(256, np.int64)          # 0 other, 1 lower, 2 upper, 3 digit, 4 sign, 5 beyond ASCII
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A] = 1, 2, 3
_KIND[[ord(c) for c in "+/_.-~"]] = 4
_KIND[0x80:] = 5


def base_spans(text):
    """(kind number, start, end) of the base kinds, in order of start, then kind."""
    spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def _secret_bytes(text):
    """Byte ranges of the secret values of the base spans."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(s, e) for k, s, e in base_spans(text) if k]
    return [(len(text[:s].encode()), len(text[:e].encode())) for s, e in spans]


class Tokens:
    """Tokens of a block and their feature numbers, one column for each feature."""

    def __init__(self, data, offsets):
        self.starts, self.ends, self.doc = T.word_bounds(data, offsets, TOKEN)
        n, docs = len(self.starts), len(offsets) - 1
        if not n:
            self.ids = np.zeros((0, 1), np.int64)
            return
        kind = _KIND[data]
        size = self.ends - self.starts
        ahead = np.concatenate([[0], np.cumsum(kind == 3)])
        count = lambda k: (c := np.concatenate([[0], np.cumsum(kind == k)]))[self.ends] - c[self.starts]
        digits, lowers, uppers, signs, others = ahead[self.ends] - ahead[self.starts], count(1), count(2), count(4), count(5)
        inside = np.zeros(len(data) + 1, np.int64)
        inside[1:len(data)] = np.cumsum(kind[1:] != kind[:-1])
        changes = inside[self.ends - 1] - inside[self.starts]
        long = np.digitize(size, [4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
        share = np.digitize(digits / size, [0.01, 0.15, 0.3, 0.5, 0.99])
        mixed = np.digitize(changes / size, [0.01, 0.1, 0.2, 0.35, 0.5])
        make_up = (digits > 0) + 2 * (lowers > 0) + 4 * (uppers > 0) + 8 * (signs > 0) + 16 * (others > 0)
        shape = make_up * 11 + long
        word = T.hash_spans(T.LOWER[data], self.starts, self.ends)
        same = np.zeros(n, bool)
        same[1:] = self.doc[1:] == self.doc[:-1]
        before = lambda x, gone=0: np.where(same, np.roll(x, 1), gone)
        after = lambda x, gone=0: np.where(np.append(same[1:], False), np.roll(x, -1), gone)
        left = np.where(np.isin(self.starts, offsets[:-1]), 0, data[np.maximum(self.starts - 1, 0)].astype(np.int64))
        right = np.where(np.isin(self.ends, offsets[1:]), 0, data[np.minimum(self.ends, len(data) - 1)].astype(np.int64))
        gap = before((right << 8)) + left
        per_doc = np.bincount(self.doc, minlength=docs)
        signs_of = np.bincount(self.doc, (digits > 0) & (lowers + uppers > 0), docs) / np.maximum(per_doc, 1)
        look = np.digitize(signs_of, [0.001, 0.01, 0.05, 0.2])[self.doc] * 4 + np.digitize(per_doc, [20, 200, 2000])[self.doc]
        previous = before((word & np.uint64(0xFFFF)).astype(np.int64), -1)
        previous2 = np.where(same & before(same, False), np.roll(word, 2) & np.uint64(0xFFFF), 0).astype(np.int64)
        columns = [shape, make_up * 6 + share, make_up * 6 + mixed, share * 36 + mixed * 6 + np.digitize(size, [8, 16, 24, 32, 48]),
                   left, right, gap, previous, previous2, before(shape, -1), after(shape, -1), look,
                   (previous << 4) + long, (word & np.uint64(0xFFFF)).astype(np.int64)]
        self.ids = np.stack([(T.mix(c.astype(np.uint64) + T.PLACES[j]) & np.uint64(FEATURES - 1)).astype(np.int64)
                             for j, c in enumerate(columns)], 1)

    def scores(self, weights):
        total = weights[self.ids[:, 0]].copy() if len(self.ids) else np.zeros((0, 3))
        for j in range(1, self.ids.shape[1]):
            total += weights[self.ids[:, j]]
        return total


def _made_up(draw):
    """A secret-looking text of one of many formats, or a harmless lookalike, with its value or None."""
    some = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    every, lower = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    value = draw.choice([
        lambda: some(every, draw.randint(16, 48)), lambda: some(every + "+/", draw.randint(24, 64)),
        lambda: "ghp_" + some(every, 36), lambda: "sk-" + some(every, draw.randint(32, 48)), lambda: some("0123456789abcdef", draw.randint(32, 64)),
        lambda: "xoxb-" + some(string.digits, 11) + "-" + some(every, 24), lambda: "glpat-" + some(every + "_-", 20),
        lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "eyJ" + some(every, 30) + "." + some(every + "_-", 40),
        lambda: some(lower, draw.randint(20, 40)), lambda: some(string.ascii_uppercase + string.digits, draw.randint(20, 32))])()
    name = draw.choice(["pwd", "passphrase", "credential", "auth", "bearer", "Authorization: Bearer", "private_key", "access_key",
                        "client_secret", "key", "password is", "token", "secret", "DB_PASS", ""])
    join = draw.choice([" = ", "=", ": ", ' = "', " ", ":"])
    if draw.random() < 0.35:
        plain = draw.choice([
            lambda: some(string.digits, 16), lambda: ".".join(str(draw.randint(1, 255)) for _ in range(4)), lambda: f"{some(string.ascii_lowercase, 8)}.{draw.randint(1, 99)}@mail{draw.randint(1, 9)}.example.com",
            lambda: f"+1 ({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}", lambda: some(string.ascii_lowercase, draw.randint(18, 34)),
            lambda: some(string.ascii_uppercase, draw.randint(8, 30)), lambda: f"https://www.{some(string.ascii_lowercase, 9)}.example.org/en/{draw.randint(1, 999)}.html",
            lambda: f"20{draw.randint(10, 29)}-0{draw.randint(1, 9)}-{draw.randint(10, 28)}", lambda: f"v{draw.randint(1, 9)}.{draw.randint(0, 20)}.{draw.randint(0, 9)}",
            lambda: some(string.ascii_lowercase, 6) + "_" + some(string.ascii_lowercase, 7), lambda: some(string.ascii_lowercase, 9) + "-" + some(string.ascii_lowercase, 6)])()
        return f"{draw.choice(['', '', 'number ', 'key '])}{plain}", None
    return f"{name}{join}{value}" if name else value, value


def train(texts, seed=11):
    """(weights, transitions) from the base spans of ``texts`` and secrets set into them."""
    draw = random.Random(seed)
    rows, marks = [], []
    for text in texts:
        words = text.split(" ")
        spans = []
        for _ in range(draw.randint(0, 3)):
            made, value = _made_up(draw)
            words.insert(draw.randint(0, len(words)), made)
            spans.append(value)
        text = " ".join(words)
        found = _secret_bytes(text)
        for value in filter(None, spans):
            at = text.find(value)
            found.append((len(text[:at].encode()), len(text[:at].encode()) + len(value.encode())))
        rows.append(text)
        marks.append(found)
    data, offsets = T.strings(pa.array(rows, pa.large_string()))
    tokens = Tokens(data, offsets)
    if not len(tokens.starts):
        return None
    labels = np.full(len(tokens.starts), OUTSIDE)
    for doc, found in enumerate(marks):
        lo, hi = np.searchsorted(tokens.doc, [doc, doc + 1])
        for begin, end in found:
            hit = lo + np.flatnonzero((tokens.starts[lo:hi] < offsets[doc] + end) & (tokens.ends[lo:hi] > offsets[doc] + begin))
            labels[hit] = INSIDE
            labels[hit[:1]] = BEGIN
    lengths = np.bincount(tokens.doc, minlength=len(rows))
    columns = tokens.ids.shape[1]

    def spread(gradient):
        return np.stack([np.bincount(tokens.ids.ravel(), np.repeat(gradient[:, c], columns), FEATURES) for c in range(3)], 1)

    weights, trans = crf.fit(tokens.scores, spread, FEATURES, labels, lengths[lengths > 0], 3, rounds=40, rate=0.1)
    return weights.astype(np.float32), trans


def training_texts(docs, most=TRAIN_DOCS):
    ids = docs.where("doc_id is not null and text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return sorted(r["text"] for r in sampled(docs, ids, characters=TRAIN_RUN).collect())


def tagged(tokens, weights, trans):
    """(first, last) token numbers of the runs that Viterbi begins."""
    scores = tokens.scores(weights).astype(float)
    lead = scores[:, OUTSIDE] - scores[:, :OUTSIDE].max(1, initial=-np.inf)
    sure = lead > 2 * (trans.max() - trans.min())
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return []
    cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(tokens.doc[open_]) > 0)) + 1
    runs = []
    for part in np.split(open_, cut):
        a, b = part[0], part[-1] + 1
        before = OUTSIDE if a and tokens.doc[a - 1] == tokens.doc[a] else None
        after = OUTSIDE if b < len(tokens.doc) and tokens.doc[b] == tokens.doc[a] else None
        last = OUTSIDE
        for i, state in enumerate(crf.viterbi(scores[a:b], trans, before, after), a):
            if state == BEGIN or (state == INSIDE and last == OUTSIDE):
                runs.append([i, i])
            elif state == INSIDE:
                runs[-1][1] = i
            last = state
    return runs


def _without(text, spans, mark):
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs, model, name="secrets", mark=None):
    """``docs`` with column ``name``: array of (kind, start, end) in order; all other columns stay.

    With ``mark`` also a column ``<name>_clean``: the text with the spans replaced, or null
    where there are none.
    """
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_text"))
            found, clean = [], []
            for lo, hi, data, offsets in T.blocks(column):
                added = {}
                if model:
                    tokens = Tokens(data, offsets)
                    for first, last in tagged(tokens, *model):
                        added.setdefault(int(tokens.doc[first]), []).append((int(tokens.starts[first]), int(tokens.ends[last])))
                for i, text in enumerate(column.slice(lo, hi - lo).to_pylist()):
                    spans = base_spans(text) if text else []
                    if i in added:
                        base, raw = list(spans), data[offsets[i]:offsets[i + 1]]
                        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                        for s, e in added[i]:
                            s, e = int(begins[s - offsets[i]]), int(begins[e - offsets[i]])
                            if not any(x < e and s < y for _, x, y in base):
                                spans.append((3, s, e))
                        spans.sort(key=lambda x: (x[1], x[0]))
                    clean.append(_without(text, spans, mark) if spans and mark is not None else None)
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans])
            kept = batch.select([f for f in batch.schema.names if f != "_text"])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, kind), pa.array(clean, pa.string())],
                                             [*kept.schema.names, "_secrets", "_clean"])

    plain = docs.select([docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)] + [docs["text"].alias("_text")])
    fields = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    done = plain.mapInArrow(run, f"{fields}, _secrets array<struct<kind:string,start:bigint,end:bigint>>, _clean string")
    return done.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)] + [F.col("_secrets").alias(name)] + (
        [] if mark is None else [F.col("_clean").alias(f"{name}_clean")]))


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs):
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``."""
    rows = scan(docs.select("doc_id", "text"), train(training_texts(docs)))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_written(base), 256).alias("base_sha256"),
                       _written(F.col("secrets")).alias("spans"), count("crf").alias("n_crf"))


def redacted(docs, mark="[secret]"):
    """``docs`` with each secret span replaced by ``mark`` and ``n_chars``, if there, counted anew."""
    name = free_name(docs, "secrets")
    clean = free_name(docs, f"{name}_clean")
    rows = scan(docs, train(training_texts(docs)), name, mark).toDF(*docs.columns, name, clean)
    columns = {"text": F.coalesce(F.col(clean), F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length(F.col(clean)), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return rows.select([columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def sha_of(spans):
    """base_sha256 of (kind, start, end) triples, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
