"""Language model, filter audit and resampling against brute force or SQL, and on odd tables."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from compare import difference

from spectralake.llm import filter_audit, logbilinear, resampling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, c0 int, _text string, lm int, part int"
# nulls, empty and blank texts, ties, repeated rows and ids, a long text, names that clash
ODD = [(1, None, None, 1, "x", 1, 1), (2, "", "", 2, None, 2, 2), (3, " \t\n", "a", 3, "y", 3, 3), (4, "the and of the", "a", 4, "z", 4, 4),
       (5, "the and of the", None, 5, "", 5, 5), (5, "the and of the", None, 5, "", 5, 5), (None, "the and of the", "b", 6, "q", 6, 6),
       (6, "É é É #x Ab cd\x1fEF " * 30, "b", 7, "q", 7, 7), (6, "Aé " * 400_000, "b", 7, "q", 7, 7), (7, "w" * 100 + " the " + "w" * 100, "c", 8, "", 8, 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def twin(tables, sql):
    db = duckdb.connect()
    for name, frame in tables.items():
        db.register(name, frame.toArrow())
    return db.sql(sql).df()


# 11 language model

def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def base_scores(rows):
    """{(doc_id, text): (tokens, known, base)} and N, of (doc_id, text) rows."""
    counts = collections.Counter()
    for doc_id, text in rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
            counts.update(plain_words(text))
    n, v = sum(counts.values()), len(counts)
    return {r: (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            for r in rows for w in [plain_words(r[1])]}, n


def test_base_scores_and_gain_of_the_model(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = logbilinear.report(table).toPandas()
    want, n = base_scores([tuple(r) for r in table.collect()])
    by_id = {k[0]: v for k, v in want.items()}
    for r in got.itertuples():
        tokens, known, base = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    unseen = got[got.held_out]
    assert unseen.score.sum() > unseen.base_score.sum() + 0.04 * unseen.n_tokens.sum()


def test_probabilities_sum_to_one(spark, docs):
    model = logbilinear.train(docs.limit(60), classes=40, shipped=400)
    words = [bytes(r.word).decode() for r in model.counts.collect()]
    assert model.n == 40 < len(model.shipped) <= 400 < len(words)
    for before in ("", f"{words[0]} {words[1]}", f"never-seen {model.shipped[0][0].decode()}"):
        rows = [(-1, before)] + [(i, f"{before} {w}".strip()) for i, w in enumerate([*words, "never-seen-too"])]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.lm.score for r in logbilinear.scored(table, model, ["doc_id"]).collect()}
        scorer, end = logbilinear.Scorer(model.weights), model.end
        place = {w: min(i, model.other) for i, (w, _) in enumerate(model.shipped[:model.n])}

        def ids(text):
            return logbilinear._ids(text.encode(), place.get, model.other, end)

        # each text's score without its end, over that of what stands before
        def of_end(text):
            i = ids(text)
            return scorer(logbilinear._contexts(i, end), i)[-1] / math.log(10)

        text_of = dict(rows)
        head = got[-1] - of_end(before)
        total = sum(10 ** (got[i] - of_end(text_of[i]) - head) for i in got if i >= 0) + 10 ** of_end(before)
        assert abs(total - 1) < 1e-3


def test_language_model_odd(spark, odd):
    got = logbilinear.report(odd).collect()
    want, n = base_scores([(r[0], r[1]) for r in ODD])
    assert len(got) == len(ODD)
    found = collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert found == collections.Counter((r[0], t, k, n, round(b, 6)) for r in ODD for t, k, b in [want[r[0], r[1]]])
    assert all(math.isfinite(r.score) for r in got)
    assert logbilinear.report(odd.where("false")).collect() == []
    alone = logbilinear.report(spark.createDataFrame([(35, "a b")], "doc_id long, text string").where("doc_id % 5 = 0")).collect()
    assert len(alone) == 1 and alone[0].n_tokens == 3
    model = logbilinear.train(odd)
    assert logbilinear.least_perplexed(odd, model, 1e9).columns == odd.columns
    assert logbilinear.least_perplexed(odd, model, 1e9).count() == len(ODD)


def test_without_training_documents(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = logbilinear.report(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 2 and all(math.isclose(r.base_score, 0.0, abs_tol=1e-9) for r in got)


def test_frequent_words_fit_and_are_the_most_frequent(spark):
    rows = [(bytes([i // 256, i % 256]), c) for i, c in enumerate([1000] * 5 + [3] * 200 + [1] * 500)]
    table = spark.createDataFrame(rows, "word binary, c long")
    some = logbilinear.frequent(table, 100)
    assert 20 < len(some) <= 100 and [c for _, c in some[:5]] == [1000] * 5 and {c for _, c in some[5:]} == {3}
    assert logbilinear.frequent(table.where("false")) == [] and len(logbilinear.frequent(table)) == len(rows)


# 12 filter audit

def test_audit_against_sql(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = filter_audit.report(docs, labels).toPandas()
    assert difference(got, twin({"documents": docs, "labels": labels}, filter_audit.REPORT_SQL)) is None
    assert set(got.filter_order) == filter_audit.orders() and len(got) == 600 * docs.select("source").distinct().count()


def test_audit_odd(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, None), (4, None, 1), (None, 1, 1), (99, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.where("false")):
        got = filter_audit.report(odd, marks).toPandas()
        assert difference(got, twin({"documents": odd.select("doc_id", "text", "source"), "labels": marks}, filter_audit.REPORT_SQL)) is None
        assert set(got.part) == {"", "a", "b", "c"}
    assert filter_audit.report(odd.where("false"), labels).collect() == []


def test_long_texts_are_split_like_short_ones():
    raw = ("some words\tÉ AB\n" * 200_000).encode()
    assert filter_audit._words(raw) == (len(raw.split()), 4)
    assert filter_audit.failures(raw) == 2 | 4


@pytest.mark.parametrize("n", range(1, 6))
def test_exchanges_meet_every_order_once(n):
    order, met = list(range(n)), []
    for level in [None, *filter_audit.exchanges(n)]:
        if level is not None:
            order[level:level + 2] = order[level + 1], order[level]
        met.append(tuple(order))
    assert len(met) == len(set(met)) == math.factorial(n)


def test_diagrams_against_sums_over_masks():
    draw = random.Random(1)
    for _ in range(30):
        counts = {m: (draw.randint(0, 3), draw.randint(0, 2), draw.randint(0, 1)) for m in draw.sample(range(32), draw.randint(0, 32))}
        shapley = collections.Counter()
        rows = list(filter_audit.steps_of(counts))
        total = lambda keep, i=0: sum(v[i] for m, v in counts.items() if keep(m))
        for order, step, kept, removed, redundant, alone, good, toxic, _ in rows:
            before, own = sum(1 << "ABCDE".index(x) for x in order[:step - 1]), 1 << "ABCDE".index(order[step - 1])
            here = lambda m: m & own and not m & before  # noqa: B023, E731
            assert (kept, removed) == (total(lambda m: not m & (before | own)), total(here))  # noqa: B023
            assert (redundant, alone) == (total(lambda m: m & own and m & before), total(lambda m: m == own))  # noqa: B023
            assert (good, toxic) == (total(here, 1), total(here, 2))
            shapley[order[step - 1]] += removed
        assert len(rows) == 600 and all(r[8] == shapley[r[0][r[1] - 1]] for r in rows)


# 13 resampling

def test_resampling_against_sql(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    few = spark.createDataFrame([(1, "the AND"), (2, None), (3, "é")], "item_id long, text string")
    for table, marks in ((docs, bench), (odd, few), (odd, few.where("false"))):
        got = resampling.report(table, marks).toPandas()
        want = twin({"documents": table.select("doc_id", "text"), "benchmark": marks}, resampling.REPORT_SQL)
        assert difference(got, want) is None
    assert resampling.report(odd.where("false"), few).collect() == []


def test_draw_keeps_columns_and_ranks_over_partitions(spark, docs, odd, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {r.doc_id for r in resampling.report(docs, bench).where("rank is not null").collect()}
    monkeypatch.setattr(resampling, "ROWS", 10)
    got = resampling.report(docs, bench).where("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and {r.doc_id for r in got} == want
    assert [(-r.score, r.doc_id) for r in got] == sorted((-r.score, r.doc_id) for r in got)
    drawn = resampling.drawn(odd, bench, percent=100)
    assert drawn.columns == odd.columns and {r.doc_id for r in drawn.collect()} == {6}


def test_features_across_pieces(monkeypatch):
    raw = "Ab cd,é ef\n".encode() * 300
    want = collections.Counter(h for hashes in resampling.features(raw, 3) for h in hashes)
    words = raw.decode().lower().replace(",", " ").split()
    plain = collections.Counter(zlib.crc32(" ".join(words[i:i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    assert want == plain
    whole = resampling.T.pieces
    monkeypatch.setattr(resampling.T, "pieces", lambda raw: whole(raw, 16))
    assert collections.Counter(h for hashes in resampling.features(raw, 3) for h in hashes) == plain
    assert np.array(sorted(plain.values())).sum() == 3 * len(words) - 3
