"""Solvers over many small problems at once: one array axis is the problem.

Problems of unlike size lie in padded arrays with a mask, in chunks of like size, so that
numpy works through an Arrow batch without a call per problem. Each follows the steps it
would take alone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

CHUNK = 1 << 16      # padded points worked on at once


class Lists:
    """A column of arrays of structs, from Arrow."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.at = np.asarray(column.offsets) - column.offsets[0].as_py()
        self.sizes = np.diff(self.at)
        self.values = column.flatten()

    def padded(self, field, rows):
        """(values, mask) of a numeric field of the given rows; nulls are NaN."""
        flat = self.values.field(field).cast(pa.float64()).to_numpy(zero_copy_only=False)
        width = int(self.sizes[rows].max(initial=0))
        place = np.arange(width)
        here = place < self.sizes[rows][:, None]
        return np.where(here, flat[np.where(here, self.at[rows][:, None] + place, 0)] if len(flat) else 0.0, np.nan), here

    def chunks(self):
        """Row numbers of arrays of like size, some at a time."""
        order = np.argsort(self.sizes, kind="stable")
        while len(order):
            # as many of the shortest as fit when padded to the longest of them
            cost = np.maximum(self.sizes[order], 1) * np.arange(1, len(order) + 1)
            n = max(1, int(np.searchsorted(cost, CHUNK, "right")))
            yield order[:n]
            order = order[n:]


def pack(rows, keys, points, sort=True):
    """One row per key with array ``points`` of structs of the columns ``points``, sorted by them."""
    listed = F.collect_list(F.struct(*points))
    return rows.groupBy(*keys).agg((F.array_sort(listed) if sort else listed).alias("points"))


def solved(packed, solve, names):
    """``packed`` rows with a double column for each of ``names`` and boolean ``converged``.

    ``solve(points, batch, rows)`` takes the points (``Lists``), the Arrow batch and some row
    numbers, and returns one array for each name and that of ``converged``, where NaN in
    the first value means that there is no answer.
    """
    def run(batches):
        for batch in batches:
            points, n = Lists(batch.column(batch.schema.get_field_index("points"))), len(batch)
            out = [np.full(n, np.nan) for _ in names]
            settled = np.zeros(n, bool)
            for rows in points.chunks():
                *values, settled[rows] = solve(points, batch, rows)
                for column, value in zip(out, values):
                    column[rows] = value
            none = np.isnan(out[0])
            columns = [pa.array(c, mask=np.isnan(c)) for c in out] + [pa.array(settled, mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names, "converged"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    return packed.mapInArrow(run, f"{fields}, " + "".join(f"{n} double, " for n in names) + "converged boolean")


def least_squares(model, y, here, start, low, high, steps=50, tol=1e-7):
    """Damped Gauss-Newton in a box for each row of ``y`` where ``here``; as ``solver.bounded_least_squares``.

    ``model(p, rows)`` gives the curves of parameters ``p`` (row, set, parameter) for the
    problems ``rows``. Returns parameters, sums of squares and whether each row settled.
    """
    start = np.asarray(start, float)
    low, high = np.broadcast_to(low, start.shape), np.broadcast_to(high, start.shape)
    p, unit = np.clip(start, low, high), np.eye(start.shape[1])
    y = np.where(here, y, 0.0)
    sse, damping, settled = np.full(len(p), np.inf), np.full(len(p), 1e-3), np.zeros(len(p), bool)
    live = np.arange(len(p))
    for _ in range(steps):
        if not len(live):
            break
        q, lo, hi, mask = p[live], low[live], high[live], here[live]
        size = 1e-7 * np.maximum(np.abs(q), 1e-4)
        size = np.where(q + size > hi, -size, size)      # into the box at the upper wall
        curves = model(np.concatenate([q[:, None], q[:, None] + unit * size[:, :, None]], axis=1), live) * mask[:, None]
        rest = y[live] - curves[:, 0]
        now = np.einsum("an,an->a", rest, rest)
        jac = (curves[:, 1:] - curves[:, :1]) / size[:, :, None]
        slope = (jac @ rest[:, :, None])[..., 0]
        free = ~(((q <= lo) & (slope < 0)) | ((q >= hi) & (slope > 0)))
        normal = np.where(free[:, :, None] & free[:, None], jac @ jac.transpose(0, 2, 1), 0.0)
        scale = np.maximum(np.einsum("app->ap", normal), 1e-30)
        slope = np.where(free, slope, 0.0)
        gain, trial, damp = np.zeros(len(live)), q.copy(), damping[live]
        open_ = np.flatnonzero(free.any(1))
        while len(open_):
            weight = np.where(free[open_], damp[open_, None] * scale[open_], 1.0)
            move = np.linalg.solve(normal[open_] + unit * weight[:, None], slope[open_][..., None])[..., 0]
            there = np.clip(q[open_] + move, lo[open_], hi[open_])
            left = y[live[open_]] - model(there[:, None], live[open_])[:, 0] * mask[open_]
            better_by = now[open_] - np.einsum("an,an->a", left, left)
            better = better_by > 0
            trial[open_[better]], gain[open_[better]] = there[better], better_by[better]
            damp[open_[~better]] *= 8.0
            open_ = open_[~better & (damp[open_] < 1e9)]
        moved, remain = gain > 0, now - gain
        p[live], sse[live] = trial, remain
        damping[live] = np.where(moved, np.maximum(damp / 9.0, 1e-12), damp)
        done = ~moved | (gain <= tol * remain) | (remain == 0)
        settled[live[done]] = True
        live = live[~done]
    return p, sse, settled


def gaussians(x, area, centre, sigma):
    """Sum of area-normalised Gaussians: parameters (row, set, line), ``x`` (row, point)."""
    z = (x[:, None, None] - centre[..., None]) / sigma[..., None]
    return (area[..., None] / (np.sqrt(2 * np.pi) * sigma[..., None]) * np.exp(-z * z / 2)).sum(axis=2)


def solve_five(main, near, far, right):
    """Solve symmetric positive systems of five diagonals side by side; all arrays are (row, place)."""
    n = main.shape[1]
    pivot, one, two, z = np.zeros_like(main), np.zeros_like(main), np.zeros_like(main), np.zeros_like(main)
    for i in range(n):
        pivot[:, i], z[:, i], step = main[:, i], right[:, i], near[:, i].copy()
        if i > 0:
            pivot[:, i] -= one[:, i - 1] ** 2 * pivot[:, i - 1]
            z[:, i] -= one[:, i - 1] * z[:, i - 1]
            step -= one[:, i - 1] * two[:, i - 1] * pivot[:, i - 1]
        if i > 1:
            pivot[:, i] -= two[:, i - 2] ** 2 * pivot[:, i - 2]
            z[:, i] -= two[:, i - 2] * z[:, i - 2]
        one[:, i], two[:, i] = step / pivot[:, i], far[:, i] / pivot[:, i]
    x = z / pivot
    for i in range(n - 2, -1, -1):
        x[:, i] -= one[:, i] * x[:, i + 1] + (two[:, i] * x[:, i + 2] if i < n - 2 else 0.0)
    return x


def smooth_below(y, sizes, stiffness, weight, rounds):
    """Asymmetric least squares for each row of ``y``, whose first ``sizes`` places count; as ``solver.smooth_below``."""
    place, inner = np.arange(y.shape[1]), sizes[:, None] - 2
    here, y = place < sizes[:, None], np.where(place < sizes[:, None], y, 0.0)
    main = sum(stiffness * square * ((place >= shift) & (place < shift + inner)) for shift, square in ((0, 1.0), (1, 4.0), (2, 1.0)))
    near = -2 * stiffness * ((place < inner) * 1.0 + ((place >= 1) & (place < inner + 1)))
    far = stiffness * (place < inner)
    curve, settled = y.copy(), sizes < 3
    live, side, w = np.flatnonzero(~settled), np.full(y.shape, 9.0), np.ones(y.shape)
    for _ in range(rounds):
        if not len(live):
            break
        k, there = w[live], here[live]
        curve[live] = solve_five(np.where(there, main[live] + k, 1.0), near[live], far[live], np.where(there, k * y[live], 0.0))
        now = np.where(there, np.sign(y[live] - curve[live]), 0.0)
        same = (now == side[live]).all(1)
        side[live], settled[live[same]] = now, True
        w[live] = np.choose(now.astype(int) + 1, (1 - weight, 0.0, weight))
        live = live[~same]
    return curve, settled


def polynomial_below(y, degree, rounds=200, tol=1e-6):
    """Polynomial under each row of ``y``, all of one size; as ``solver.polynomial_below``."""
    n = y.shape[1]
    basis = np.linalg.qr(np.polynomial.legendre.legvander(np.linspace(-1, 1, n), min(degree, n - 1)))[0]
    span = np.maximum(np.ptp(y, axis=1), 1e-300)
    base, settled = y @ basis @ basis.T, np.zeros(len(y), bool)
    live = np.arange(len(y))
    for _ in range(rounds):
        if not len(live):
            break
        lower = np.minimum(y[live], base[live]) @ basis @ basis.T
        done = np.abs(lower - base[live]).max(1) <= tol * span[live]
        base[live] = lower
        settled[live[done]] = True
        live = live[~done]
    return base, settled
