import numpy as np
import pyarrow as pa

from spectralake.llm import crf
from spectralake.llm import text as T


def hashes_of(texts, limit=T.BLOCK):
    out = {}
    for lo, hi, data, offsets in T.blocks(pa.array(texts), limit):
        words, doc, starts, ends = T.word_hashes(data, offsets)
        for w, d, s, e in zip(words.tolist(), doc.tolist(), starts, ends):
            out.setdefault(lo + d, []).append((w, bytes(T.LOWER[data[s:e]])))
    return out


def test_words_do_not_depend_on_blocks_or_places():
    texts = ["One two\tthree", None, "", "two ONE", "  é É\x0bone ", "x" * 50]
    every = hashes_of(texts)
    assert [[w for _, w in every.get(i, [])] for i in range(6)] == [t.lower().encode().split() if t and "É" not in t else
                                                                    ([] if not t else ["é".encode(), "É".encode(), b"one"]) for t in texts]
    assert hashes_of(texts, limit=1) == every
    names = {}
    for words in every.values():
        for h, w in words:
            assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)


def test_text_longer_than_a_block_hashes_alike():
    word = "abc def "
    long = word * (T.BLOCK // 4)
    got = hashes_of([word, "  " + long])
    assert {h for h, _ in got[1]} == {h for h, _ in got[0]}


def test_slices_of_columns():
    column = pa.array(["a b", "c", None, "d e f"]).slice(1, 3)
    data, offsets = T.strings(column)
    assert bytes(data[offsets[0]:offsets[-1]]) == b"cd e f" and np.diff(offsets).tolist() == [1, 0, 5]


def test_forward_backward_equals_plain_recursion():
    random = np.random.default_rng(1)
    lengths = [1, 2, 31, 32, 33, 100, 64]
    emit, trans = random.normal(size=(sum(lengths), 3)), random.normal(size=(3, 3))
    got = crf.forward_backward(emit, trans, lengths)[0]
    at = 0
    for n in lengths:
        e, t = np.exp(emit[at:at + n]), np.exp(trans)
        alpha, beta = [e[0]], [np.ones(3)]
        for x in e[1:]:
            alpha.append((alpha[-1] @ t) * x)
        for x in e[:0:-1]:
            beta.append(t @ (x * beta[-1]))
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def test_viterbi_equals_best_of_all_paths():
    import itertools
    random = np.random.default_rng(2)
    for before, after in ((None, None), (2, None), (1, 2)):
        emit, trans = random.normal(size=(6, 3)), random.normal(size=(3, 3))
        def score(path):
            value = sum(emit[i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            return value + (trans[before, path[0]] if before is not None else 0) + (trans[path[-1], after] if after is not None else 0)
        assert crf.viterbi(emit, trans, before, after) == list(max(itertools.product(range(3), repeat=6), key=score))
