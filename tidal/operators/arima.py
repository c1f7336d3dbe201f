"""ARIMA(p, d, q) without a constant, by exact maximum likelihood, many series side by side.

The differenced series is an ARMA process in state-space form (Harvey's): a
Kalman filter started from the stationary distribution gives its exact Gaussian
likelihood, with the variance concentrated out.  Coefficients are searched
through partial autocorrelations, so they stay stationary and invertible: all
points of a coarse grid first, then a compass search from the best one.  Every
step of the filter is one set of array operations over all series and points.
"""

from __future__ import annotations

import itertools

import numpy as np

#: Partial autocorrelations of the coarse grid, and the largest one the search may reach (as tanh).
GRID = (-0.85, -0.4, 0.0, 0.4, 0.85)
REACH = 4.0
#: Series whose grids are computed side by side.
GRID_SERIES = 256
#: First and last step of the compass search, in inverse hyperbolic tangents of partial autocorrelations.
STEP, LAST_STEP = 0.4, 0.004
#: Least gain of log likelihood that counts.
GAIN = 1e-5
#: Fewest observations that are fitted.
MIN_POINTS = 5


def coefficients(partial: np.ndarray) -> np.ndarray:
    """AR coefficients of each row of partial autocorrelations (Durbin-Levinson)."""
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        a = partial[:, k:k + 1]
        out[:, :k], out[:, k:k + 1] = out[:, :k] - a * out[:, :k][:, ::-1], a
    return out


def _stationary(phi: list[np.ndarray], load: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Upper triangle of the stationary state covariance; ``phi`` and ``load`` have an item for each state.

    Its recursion steps down the diagonals, so all of it follows from the first row, which solves as many equations.
    """
    r = len(phi)
    noise = [sum(load[k] * load[j + k] for k in range(r - j)) for j in range(r)]
    row = [*noise, 0.0, 0.0]
    if any(x is not phi[-1] for x in phi[2:]) or (r > 2 and np.any(phi[-1])):  # three or more AR coefficients
        shape = np.broadcast_shapes(*(x.shape for x in (*phi, *load)))
        system = np.broadcast_to(np.eye(r), (*shape, r, r)).copy()
        for j in range(r):
            for k in range(r - j):
                system[..., j, 0] -= phi[k] * phi[j + k]
                if j + k + 1 < r:
                    system[..., j, j + k + 1] -= phi[k]
                if k + 1 < r:
                    system[..., j, k + 1] -= phi[j + k]
        right = np.stack([np.broadcast_to(x, shape) for x in noise], axis=-1)
        row[:r] = np.moveaxis(np.linalg.solve(system, right[..., None])[..., 0], -1, 0)
    else:
        one, two = phi[0], phi[1] if r > 1 else np.zeros_like(phi[0])
        for j in range(r - 1, 1, -1):
            row[j] = noise[j] + one * row[j + 1] + two * row[j + 2]
        known = ((noise[1] if r > 1 else 0.0) + one * row[2] + two * row[3 if r > 1 else 2]) / (1 - two)
        row[0] = ((2 * one * known + 2 * two * row[2] + noise[0]) * (1 - two)
                  / ((1 + two) * (1 - two - one) * (1 - two + one)))
        row[1] = known + one * two * row[0] / (1 - two)
    cov = {(0, j): row[j] for j in range(r)}
    for i in range(r - 1, 0, -1):
        for j in range(r - 1, i - 1, -1):
            cov[i, j] = load[i] * load[j] + phi[i] * phi[j] * row[0] + cov.get((i + 1, j + 1), 0.0)
            cov[i, j] += (phi[i] * row[j + 1] if j + 1 < r else 0.0) + (phi[j] * row[i + 1] if i + 1 < r else 0.0)
    return cov


#: Steps whose variances are multiplied before one logarithm is taken.
LOG_EVERY = 8


def _filter(columns: np.ndarray, start: np.ndarray, phi: np.ndarray, theta: np.ndarray, ahead: int | None = None):
    """The Kalman filter over ``columns`` (steps x series) under coefficients (``p`` or ``q`` x ... x series).

    The first state is observed without error: after each step its covariances are zero, so the next covariance is
    the rest moved up by one plus the noise, without any AR coefficient.  It does not depend on the data
    either: a last axis of 1 in the coefficients computes it once for all series that start together.
    """
    steps, n = columns.shape
    shape = np.broadcast_shapes(phi.shape[1:], theta.shape[1:], (n,))
    r = max(len(phi), len(theta) + 1)
    narrow = np.broadcast_shapes(phi.shape[1:], theta.shape[1:])
    nought = np.zeros(narrow)
    phi, load = [*phi, *[nought] * (r - len(phi))], [np.ones(narrow), *theta, *[nought] * (r - 1 - len(theta))]
    noise = {(i, j): load[i] * load[j] for i in range(r) for j in range(i, r)}
    cov = _stationary(phi, load)
    state = [np.zeros(shape) for _ in range(r)]
    square, logs, product = np.zeros(shape), 0.0, 1.0
    fitted = np.full((steps, *shape), np.nan) if ahead is not None else None
    late = int(start.max(initial=0))
    for t in range(int(start.min(initial=0)), steps):
        all_on = t >= late
        on = True if all_on else start <= t
        var = np.maximum(cov[0, 0], 1e-12)
        inverse = 1.0 / var
        error = columns[t] - state[0]
        if ahead is not None:
            fitted[t] = np.where(on, state[0], np.nan)
        if not all_on:
            error, var = np.where(on, error, 0.0), np.where(on, var, 1.0)
        product = product * var
        if t % LOG_EVERY == 0:
            logs, product = logs + np.log(product), 1.0
        scaled = error * inverse
        square += error * scaled
        seen = state[0] + error
        state = [phi[i] * seen + (state[i + 1] + cov[0, i + 1] * scaled if i + 1 < r else 0.0) for i in range(r)]
        gain = [cov[0, i] * inverse for i in range(r)]
        after = {(i, j): noise[i, j] + (cov[i + 1, j + 1] - gain[i + 1] * cov[0, j + 1]) if j + 1 < r else noise[i, j]
                 for i, j in noise}
        cov = after if all_on else {at: np.where(on, after[at], cov[at]) for at in after}
    logs = logs + np.log(product)
    count = (steps - start).astype(float)
    scale = np.maximum(square / count, 1e-300)
    value = -0.5 * (count * (np.log(2 * np.pi * scale) + 1) + logs)
    if ahead is None:
        return value
    future = np.zeros((ahead, *shape))
    for h in range(ahead):
        future[h] = state[0]
        state = [phi[i] * state[0] + (state[i + 1] if i + 1 < r else 0.0) for i in range(r)]
    return value, fitted, future


def kalman(z: np.ndarray, start: np.ndarray, phi: np.ndarray, theta: np.ndarray, ahead: int | None = None):
    """Log likelihood of each row of ``z`` from its column ``start`` on, under the row's coefficients.

    With ``ahead`` also the one-step predictions and as many forecasts after the last column.
    """
    got = _filter(np.ascontiguousarray(z.T), start, phi.T, theta.T, ahead)
    return got if ahead is None else (got[0], got[1].T, got[2].T)


def estimate(z: np.ndarray, start: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phi, theta and log likelihood of each row of ``z``."""
    n, width = len(z), p + q
    if not width:
        none = np.zeros((n, 0))
        return none, none, kalman(z, start, none, none)
    columns = np.ascontiguousarray(z.T)

    def value(columns: np.ndarray, start: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Likelihoods of ``points`` (points x series, or 1 for all of them, x parameters)."""
        flat = np.tanh(points.reshape(-1, width))
        shape = (-1, *points.shape[:2])
        return _filter(columns, start, np.ascontiguousarray(coefficients(flat[:, :p]).T).reshape(p, *shape[1:]),
                       -np.ascontiguousarray(coefficients(flat[:, p:]).T).reshape(q, *shape[1:]))

    grid = np.arctanh(np.array(list(itertools.product(GRID, repeat=width))))
    all_rows = np.arange(n)
    best, top = np.zeros(n, int), np.zeros(n)
    for i in range(0, n, GRID_SERIES):
        some = slice(i, i + GRID_SERIES)
        found = value(np.ascontiguousarray(columns[:, some]), start[some], grid[:, None])
        best[some], top[some] = found.argmax(axis=0), found.max(axis=0)
    at = grid[best].copy()
    step, live = np.full(n, STEP), all_rows
    ways = np.concatenate([np.eye(width), -np.eye(width), *([np.ones((1, width)), -np.ones((1, width))] if width > 1 else [])])
    if width > 1:  # AR and MA against each other: the ridge of factors that nearly cancel
        ridge = np.concatenate([np.ones(p), -np.ones(q)])[None]
        ways = np.concatenate([ways, ridge, -ridge])
    while len(live):
        tries = np.clip(at[live] + step[live, None] * ways[:, None], -REACH, REACH)
        got = value(np.ascontiguousarray(columns[:, live]), start[live], tries)
        pick = got.argmax(axis=0)
        here = np.arange(len(live))
        better = got[pick, here] > top[live] + GAIN
        won = live[better]
        at[won], top[won] = tries[pick[better], here[better]], got[pick[better], here[better]]
        step[won] *= 1.5
        step[live[~better]] /= 2
        live = live[step[live] >= LAST_STEP]
    point = np.tanh(at)
    return coefficients(point[:, :p]), -coefficients(point[:, p:]), top


def fit(series: list[np.ndarray], p: int, d: int, q: int, steps: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """(fitted, forecast) of each series, None for one too short or not finite.

    (0, 1, 0) is exact: the last value repeated, fitted = previous value.  The
    first ``d`` fitted values are undefined (NaN).
    """
    if d not in (0, 1):
        raise ValueError("differences of order 0 or 1 only")
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(series)
    use = [i for i, y in enumerate(series)
           if len(y) >= MIN_POINTS and len(y) - d > p + q and np.isfinite(y).all()]
    if not use:
        return out
    diffs = [np.diff(series[i], n=d) for i in use]
    longest = max(map(len, diffs))
    scale = np.array([np.sqrt(np.mean(z * z)) or 1.0 for z in diffs])
    z = np.zeros((len(use), longest))
    for row, (diff, s) in enumerate(zip(diffs, scale)):
        z[row, longest - len(diff):] = diff / s
    start = longest - np.array(list(map(len, diffs)))
    phi, theta, _ = estimate(z, start, p, q)
    _, fitted, future = kalman(z, start, phi, theta, steps)
    for row, i in enumerate(use):
        y, inside = np.asarray(series[i], float), fitted[row, start[row]:] * scale[row]
        ahead = future[row] * scale[row]
        if d:
            inside, ahead = np.concatenate([[np.nan], y[:-1] + inside]), y[-1] + np.cumsum(ahead)
        if np.isfinite(ahead).all():
            out[i] = inside, ahead
    return out
