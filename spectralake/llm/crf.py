"""Linear-chain conditional random fields in numpy, over many sequences at once.

Sequences are laid end to end in one array with their lengths. They are cut into chunks
of ``CHUNK`` places whose transfer matrices are multiplied side by side, so one long
sequence costs no long loop; the results are those of the plain recursions.
"""

import numpy as np

CHUNK = 32


class _Chunks:
    """Where the chunks of all sequences lie."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        lengths = lengths[lengths > 0]
        self.count = -(-lengths // CHUNK)
        begins = np.cumsum(lengths) - lengths
        self.first = np.cumsum(self.count) - self.count        # first chunk of each sequence
        order = np.arange(self.count.sum()) - np.repeat(self.first, self.count)
        start = np.repeat(begins, self.count) + order * CHUNK
        self.size = np.minimum(CHUNK, np.repeat(begins + lengths, self.count) - start)
        self.start, self.head = start, order == 0

    def at(self, t):
        """(positions, valid) of place ``t`` of every chunk."""
        valid = t < self.size
        return np.where(valid, self.start + t, self.start), valid


def _unit(x):
    return x / x.sum(-1, keepdims=True)


def forward_backward(emit, trans, lengths):
    """(marginals, alpha, beta, factors) for log scores ``emit`` (n, k) and ``trans`` (k, k)."""
    n, k = emit.shape
    factors = np.exp(emit - emit.max(1, keepdims=True)) if n else emit
    step = np.exp(trans - trans.max())
    alpha, beta = np.ones((n, k)), np.ones((n, k))
    if not n:
        return alpha, alpha, beta, factors
    chunks = _Chunks(lengths)
    places = [chunks.at(t) for t in range(int(chunks.size.max()))]
    moves = None
    for t, (at, valid) in enumerate(places):
        if t == 0:
            moves = np.where(chunks.head[:, None, None], np.eye(k), step) * factors[at][:, None, :]
        else:
            new = (moves.reshape(-1, k) @ step).reshape(-1, k, k) * factors[at][:, None, :]
            moves = np.where(valid[:, None, None], new / new.sum((1, 2), keepdims=True), moves)
    into, out = np.ones((len(moves), k)), np.ones((len(moves), k))
    for c in range(1, int(chunks.count.max())):
        now = chunks.first[chunks.count > c] + c
        into[now] = _unit(np.einsum("ni,nij->nj", into[now - 1], moves[now - 1]))
    for c in range(int(chunks.count.max()) - 2, -1, -1):
        now = chunks.first[chunks.count > c + 1] + c
        out[now] = _unit(np.einsum("nij,nj->ni", moves[now + 1], out[now + 1]))
    state = into
    for t, (at, valid) in enumerate(places):
        moved = state @ step
        if t == 0:
            moved[chunks.head] = state[chunks.head]
        state = np.where(valid[:, None], _unit(moved * factors[at]), state)
        alpha[at[valid]] = state[valid]
    state = out
    for at, valid in reversed(places):
        beta[at[valid]] = state[valid]
        state = np.where(valid[:, None], _unit((factors[at] * state) @ step.T), state)
    return _unit(alpha * beta), alpha, beta, factors


def viterbi(emit, trans, before=None, after=None):
    """The best states of one sequence; ``before`` and ``after`` are fixed neighbours."""
    score = emit[0] + (0 if before is None else trans[before])
    back = []
    for row in emit[1:]:
        ways = score[:, None] + trans
        back.append(ways.argmax(0))
        score = ways.max(0) + row
    if after is not None:
        score = score + trans[:, after]
    path = [int(score.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def fit(score, spread, n_weights, labels, lengths, k, rounds=40, rate=0.1, decay=1e-5, seed=0):
    """Weights (n_weights, k) and transitions (k, k) of highest likelihood, by Adam.

    ``score(weights)`` gives the emission scores of all places, ``spread(gradient)`` takes
    a gradient by place back to the weights.
    """
    weights, trans = np.zeros((n_weights, k)), np.zeros((k, k))
    same = np.ones(len(labels), bool)
    ends = np.cumsum(np.asarray(lengths))[:-1]
    same[0] = False
    same[ends[ends < len(labels)]] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (labels[:-1][same[1:]], labels[1:][same[1:]]), 1)
    truth = np.eye(k)[labels]
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    for turn in range(1, rounds + 1):
        marginals, alpha, beta, factors = forward_backward(score(weights), trans, lengths)
        right = np.flatnonzero(same)
        ways = alpha[right - 1][:, :, None] * np.exp(trans - trans.max()) * (factors * beta)[right][:, None, :]
        expected = (ways / ways.sum((1, 2), keepdims=True)).sum(0)
        for value, gradient, m, v in ((weights, spread(marginals - truth) / len(labels) + decay * weights, 0, 1),
                                      (trans, (expected - seen) / len(labels), 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * gradient
            state[v] = 0.99 * state[v] + 0.01 * gradient ** 2
            value -= rate * (state[m] / (1 - 0.9 ** turn)) / (np.sqrt(state[v] / (1 - 0.99 ** turn)) + 1e-8)
    return weights, trans
