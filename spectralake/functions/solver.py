"""Small dense numerics used inside grouped jobs."""

import numpy as np


def bounded_least_squares(model, start, low, high, x, y, steps=50, tol=1e-7):
    """Damped Gauss-Newton with the parameters held inside a box.

    ``model(p, x)`` takes parameters with leading axes, so one call gives the
    value and all difference quotients. Returns the parameters, the remaining sum of
    squares and whether they settled before ``steps`` ran out.
    """
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)
    sse, damping, unit = np.inf, 1e-3, np.eye(p.size)
    settled = False
    for _ in range(steps):
        size = 1e-7 * np.maximum(np.abs(p), 1e-4)
        # step inwards at the upper wall, so the derivative is taken inside the box
        size = np.where(p + size > high, -size, size)
        curves = model(np.vstack([p, p + unit * size[:, None]]), x)
        rest = y - curves[0]
        sse = float(rest @ rest)
        jac = ((curves[1:] - curves[0]) / size[:, None]).T
        slope = jac.T @ rest
        free = ~(((p <= low) & (slope < 0)) | ((p >= high) & (slope > 0)))
        if not free.any():
            settled = True
            break
        normal = jac[:, free].T @ jac[:, free]
        scale = np.maximum(np.diag(normal), 1e-30)
        gain = 0.0
        while damping < 1e9:
            trial = p.copy()
            trial[free] += np.linalg.solve(normal + np.diag(damping * scale), slope[free])
            trial = np.clip(trial, low, high)
            trial_rest = y - model(trial, x)
            gain = sse - float(trial_rest @ trial_rest)
            if gain > 0:
                break
            damping *= 8.0
        if gain <= 0:
            settled = True
            break
        p, sse, damping = trial, sse - gain, max(damping / 9.0, 1e-12)
        if gain <= tol * sse or sse == 0:
            settled = True
            break
    return p, sse, settled


def gaussian(x, area, centre, sigma):
    """Area-normalised Gaussian."""
    return area / (np.sqrt(2 * np.pi) * sigma) * np.exp(-((x - centre) ** 2) / (2 * sigma**2))


def solve_five(main, near, far, right):
    """Solve a symmetric positive system of five diagonals in time linear in its size.

    ``main`` has n entries, ``near`` and ``far`` those one and two places off it. The
    matrix is split into L D L' with two entries a row in L.
    """
    n = len(main)
    pivot, one, two, z = np.zeros(n), np.zeros(n + 1), np.zeros(n + 2), np.zeros(n)
    for i in range(n):
        # column i of L below its pivot; one[i], two[i] belong to rows i + 1, i + 2
        pivot[i] = main[i]
        z[i] = right[i]
        if i > 0:
            pivot[i] -= one[i - 1] ** 2 * pivot[i - 1]
            z[i] -= one[i - 1] * z[i - 1]
        if i > 1:
            pivot[i] -= two[i - 2] ** 2 * pivot[i - 2]
            z[i] -= two[i - 2] * z[i - 2]
        if i < n - 1:
            one[i] = (near[i] - (one[i - 1] * two[i - 1] * pivot[i - 1] if i > 0 else 0.0)) / pivot[i]
        if i < n - 2:
            two[i] = far[i] / pivot[i]
    x = z / pivot
    for i in range(n - 2, -1, -1):
        x[i] -= one[i] * x[i + 1] + (two[i] * x[i + 2] if i < n - 2 else 0.0)
    return x


def smooth_below(y, stiffness, weight, rounds):
    """Asymmetric least squares (Eilers and Boelens): a stiff curve under the signal.

    Returns the curve and whether the sides of the points had settled after ``rounds``.
    Two points or fewer have no curvature to hold: the curve is the signal.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n < 3:
        return y.copy(), True
    # diagonals of the penalty: stencils (1, -2, 1) laid over each other
    inner = n - 2
    main, near, far = np.zeros(n), np.zeros(n - 1), np.full(inner, stiffness)
    for shift, square in ((0, 1.0), (1, 4.0), (2, 1.0)):
        main[shift:shift + inner] += stiffness * square
    near[:inner] -= 2 * stiffness
    near[1:] -= 2 * stiffness
    above = None
    w = np.ones(n)
    for _ in range(rounds):
        curve = solve_five(main + w, near, far, w * y)
        side = np.sign(y - curve)
        if above is not None and (side == above).all():
            return curve, True
        above = side
        w = np.choose(side.astype(int) + 1, (1 - weight, 0.0, weight))
    return curve, False


def polynomial_below(y, degree, rounds=200, tol=1e-6):
    """Polynomial under the signal, by repeated projection on an orthonormal basis.

    What the projection leaves above itself is cut off and the rest projected again; the
    level falls until the cut no longer moves it. Returns the curve and whether it settled.
    """
    y = np.asarray(y, float)
    basis, _ = np.linalg.qr(np.polynomial.legendre.legvander(np.linspace(-1, 1, len(y)), min(degree, len(y) - 1)))
    project = lambda v: basis @ (basis.T @ v)
    span = max(float(np.ptp(y)), 1e-300)
    base = project(y)
    for _ in range(rounds):
        lower = project(np.minimum(y, base))
        moved, base = np.abs(lower - base).max(), lower
        if moved <= tol * span:
            return base, True
    return base, False


def spline_second_derivatives(x, y):
    """Second derivatives at the knots of the not-a-knot cubic spline, in linear time.

    The end conditions give the outer values from their neighbours; put into the first
    and last inner equation they leave three diagonals, swept forth and back.
    """
    h = np.diff(x)
    rise = np.diff(y) / h
    low, main, high = h[1:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:-1].copy()
    right = 6 * np.diff(rise)
    p, q = h[0] / h[1], h[-1] / h[-2]
    main[0] += h[0] * (1 + p)
    main[-1] += h[-1] * (1 + q)
    if len(main) > 1:
        high[0] -= h[0] * p
        low[-1] -= h[-1] * q
    for i in range(1, len(main)):
        ratio = low[i - 1] / main[i - 1]
        main[i] -= ratio * high[i - 1]
        right[i] -= ratio * right[i - 1]
    inner = right / main
    for i in range(len(main) - 2, -1, -1):
        inner[i] = (right[i] - high[i] * inner[i + 1]) / main[i]
    first = inner[0] + p * (inner[0] - inner[1])
    last = inner[-1] + q * (inner[-1] - inner[-2])
    return np.concatenate([[first], inner, [last]])
