import re

import numpy as np

from spectralake.llm import ngram_join as nj


def brute(rows, num=80, den=100, width=5):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)] or ([tuple(words)] if words else [])
        sets[doc_id] = set(grams)
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and den * both >= num * len(sets[a] | sets[b]) and root[a] != root[b]:
                    low = min(root[a], root[b])
                    root[a] = root[b] = low
                    changed = True
    return {d: (len(sets[d]), root[d]) for d in sets}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.near_components(df, **options).collect()}


def texts():
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base.replace(f"w{i * 3} ", f"x{i} ")) for i in range(12)]
    rows += [(20 + i, base.upper()) for i in range(5)]
    rows += [(40, None), (41, ""), (42, " \t\n"), (43, "One two"), (44, "one TWO"), (45, "one two three"), (46, "İ ſ K é"), (47, "É")]
    long = " ".join(f"v{i % 997}a{i}" for i in range(30_000))
    rows += [(60, long), (61, long + " tail"), (62, long[: len(long) // 2])]
    chain = [" ".join(f"c{j}" for j in range(i * 6, i * 6 + 80)) for i in range(10)]
    rows += [(70 + i, t) for i, t in enumerate(chain)]
    return rows


def test_against_brute_force(spark):
    rows = texts()
    assert run(spark, rows) == brute(rows)


def test_blocks_of_hot_groups_lose_nothing(spark):
    rows = [r for r in texts() if r[0] < 60 or r[0] >= 70]
    assert run(spark, rows, fanout=3) == brute(rows)
    rows = [(100 + i, " ".join(f"k{j}" for j in range(i, i + 40))) for i in range(60)]
    assert run(spark, rows, fanout=4) == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_components(empty).collect() == []
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, "a b c d e f", "z"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in nj.near_components(df).collect())
    assert got == [(0, 0, None), (0, 2, None), (1, 2, 1), (1, 2, 1), (3, 2, 1)]
    kept = nj.representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 1]


def test_two_texts_of_one_id_tie_their_classes(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (3, "g h i j k l")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in nj.near_components(df).collect()} == {1}


def made(spark, monkeypatch, stars, sets, **options):
    """(links of ``grow``, rows that each comparison was sent)."""
    sent, compare = [], nj._compare

    def counted(fetch, plan, *args):
        sent.append(plan.count())
        return compare(fetch, plan, *args)

    monkeypatch.setattr(nj, "_compare", counted)
    table = spark.createDataFrame([(d, bytes(v.tobytes())) for d, v in sets.items()], "doc_id long, shingles binary")
    links = nj.grow(spark.createDataFrame(stars, "a long, b long"), lambda wanted: table.join(wanted, "doc_id"), 4, **options)
    return {frozenset(r) for r in links.collect()}, sent


def test_a_hot_subtree_of_unlike_sets_costs_as_much_as_its_ties(spark, monkeypatch):
    n = 400
    sets = {i: np.sort(nj.T.mix(np.arange(i * 100, i * 100 + 40, dtype=np.uint64))) for i in range(n)}
    sets[200] = sets[201]
    links, sent = made(spark, monkeypatch, [(i + 1, i) for i in range(n - 1)], sets, fanout=4)
    assert links == {frozenset((200, 201))}
    # each set has two ties; all blocks with all blocks would be some 80,000 rows
    assert len(sent) == 2 and sent[1] <= 2 * n


def test_minor_sets_of_a_hot_hub_meet_all_others(spark, monkeypatch):
    base = nj.T.mix(np.arange(40, dtype=np.uint64))
    sets = {i: np.sort(np.append(base, nj.T.mix(np.arange(1000 + i, 1001 + i, dtype=np.uint64)))) for i in range(30)}
    for i in range(30, 60):
        sets[i] = np.sort(nj.T.mix(np.arange(i * 1000, i * 1000 + 40, dtype=np.uint64)))
    for i in range(45, 60):
        sets[i] = sets[i - 15]
    links, _ = made(spark, monkeypatch, [(i, 0) for i in range(1, 60)], sets, fanout=3)
    root = {i: i for i in sets}
    for a, b in map(sorted, links):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert root == {i: 0 if i < 30 else i if i < 45 else i - 15 for i in sets}


def test_slices_of_a_plan_lose_nothing(spark, monkeypatch):
    rows = [r for r in texts() if r[0] < 60 or r[0] >= 70]
    monkeypatch.setattr(nj, "BROADCAST_BYTES", 5 * nj.PLAN_BYTES)
    assert run(spark, rows) == brute(rows)


def test_sets_that_share_a_passage_are_not_tied(spark, monkeypatch):
    def tied(rows):
        seen = []
        monkeypatch.setattr(nj, "grow", lambda stars, *args: seen.append(stars.count()) or stars)
        nj.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
        return seen[0]

    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, f"{own(i, 250)} {own(1000 + i // 2, 12)} {own(2000 + i, 250)}") for i in range(100)]
    assert tied(rows) <= 5
    assert tied(rows + [(i + 100, f"{t} and more") for i, t in rows]) >= 100


def test_linked_sets_share_the_keys_they_need():
    rng = np.random.default_rng(3)
    for n in [*range(1, 80), 100, 127, 128, 150, 255, 256, 300, 319, 320, 500, 511, 513, 639, 1000]:
        for _ in range(4):
            differ = int(n * 0.25 + 1e-9)
            gone = int(rng.integers(0, differ + 1))
            whole = rng.integers(0, 2**63, n + gone, dtype=np.uint64)
            one, other = np.unique(whole[:n]), np.unique(whole[gone // 2:n + gone - gone // 2 - gone % 2])
            if 100 * len(np.intersect1d(one, other)) < 80 * len(np.union1d(one, other)):
                continue
            (a, p), (b, q) = (nj.keys_of(v, v % np.uint64(3) > 0, 0.25) for v in (one, other))
            assert len(np.intersect1d(a, b)) >= min(p, q)


def test_copies_in_many_tasks_are_one_member_of_a_key(spark, monkeypatch):
    def ties(copies):
        seen = []
        monkeypatch.setattr(nj, "save", lambda df: seen.append(save(df)) or seen[-1])
        rows = [(c * 100 + i, " ".join(f"w{i // 2}x{j}" for j in range(i % 2, 200))) for c in range(copies) for i in range(40)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, copies), "doc_id long, text string")
        assert len({r.component_id for r in nj.near_components(docs).collect()}) == 20
        return seen[0].where("hub is not null").agg(nj.F.sum("a")).first()[0]

    save = nj.save
    assert ties(6) == ties(1) > 0
