"""Seasonal ARIMA with regressors and a stepwise choice of orders (Hyndman and Khandakar 2008), in NumPy.

Parameters minimise the conditional sum of squares (Nelder and Mead); regressors enter by generalised least squares on
the filtered series. Orders are searched by AICc from four starts, in the box that published fits of such series need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

BOX = (3, 3, 2, 2)  # largest p, q, P, Q


class Degenerate(ValueError):
    """A fit without a usable covariance."""


def _poly(short: np.ndarray, long: np.ndarray, season: int, sign: float) -> np.ndarray:
    a = np.concatenate([[1.0], sign * short])
    b = np.zeros(len(long) * season + 1)
    b[0] = 1.0
    b[season::season] = sign * long
    return np.convolve(a, b)


def _invert(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Solves filter * e = x forward from zeros."""
    taps = [(i, float(c)) for i, c in enumerate(filter_) if i and c]
    if not taps:
        return x.copy()
    e: list[float] = []
    for t, value in enumerate(x.tolist()):
        for i, c in taps:
            if t >= i:
                value -= c * e[t - i]
        e.append(value)
    return np.array(e)


def _apply(filter_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.convolve(filter_, x)[: len(x)]


def _steady(short: np.ndarray, long: np.ndarray) -> bool:
    """Whether both polynomials 1 - c1 z - c2 z² … have their roots outside the unit circle (step-down recursion)."""
    for c in (short.tolist(), long.tolist()):
        while c:
            r = c[-1]
            if abs(r) >= 0.999:
                return False
            c = [(c[i] + r * c[-2 - i]) / (1 - r * r) for i in range(len(c) - 1)]
    return True


def nelder_mead(f, x: np.ndarray, step: float = 0.1, rounds: int = 200, close: float = 1e-7) -> tuple[np.ndarray, float]:
    n = len(x)
    if not n:
        return x, f(x)
    points = [x] + [x + step * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < close * (abs(values[0]) + close):
            break
        centre = np.mean(points[:-1], axis=0)
        p = centre + (centre - points[-1])
        v = f(p)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            w = f(far)
            p, v = (far, w) if w < v else (p, v)
        elif v >= values[-2]:
            near = centre + 0.5 * ((p if v < values[-1] else points[-1]) - centre)
            w = f(near)
            if w < min(v, values[-1]):
                p, v = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (q - points[0]) for q in points[1:]]
                values = [values[0]] + [f(q) for q in points[1:]]
                continue
        points[-1], values[-1] = p, v
    k = int(np.argmin(values))
    return points[k], values[k]


def needs_difference(y: np.ndarray) -> bool:
    """KPSS test of level stationarity at 5 %."""
    n = len(y)
    e = y - y.mean()
    lags = int(4 * (n / 100) ** 0.25)
    s2 = float(e @ e) / n + 2 / n * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return s2 > 0 and float((np.cumsum(e) ** 2).sum()) / (n * n * s2) > 0.463


@dataclass
class Fit:
    order: tuple[int, int, int]
    seasonal: tuple[int, int, int]
    season: int
    ar: np.ndarray
    ma: np.ndarray
    beta: np.ndarray
    sigma2: float
    aicc: float
    y: np.ndarray
    x: np.ndarray

    def append(self, y: np.ndarray, x: np.ndarray | None = None) -> None:
        """New observations without new parameters."""
        if np.isnan(y).any():
            raise ValueError("an update holds a missing value")
        self.y = np.concatenate([self.y, y])
        self.x = np.vstack([self.x, self._design(len(y), x)])

    def _design(self, steps: int, x: np.ndarray | None) -> np.ndarray:
        constant = np.ones((steps, int(self.order[1] == 0)))
        return np.hstack([constant, x if x is not None else np.empty((steps, 0))])

    def predict(self, steps: int, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forecasts and their standard errors."""
        u = self.y - self.x @ self.beta
        full = np.convolve(self.ar, [1.0, -1.0]) if self.order[1] else self.ar
        e = _invert(self.ma, _apply(self.ar, np.diff(u) if self.order[1] else u))
        past, shocks = u.tolist(), [0.0] * self.order[1] + e.tolist()
        for _ in range(steps):
            value = -sum(float(c) * past[-i] for i, c in enumerate(full) if i and i <= len(past))
            value += sum(float(c) * shocks[-i] for i, c in enumerate(self.ma) if i and i <= len(shocks))
            past.append(value)
            shocks.append(0.0)
        pulse = np.zeros(steps)
        pulse[:1] = 1
        psi = _invert(full, _apply(self.ma, pulse))
        return np.array(past[-steps:]) + self._design(steps, x) @ self.beta, np.sqrt(self.sigma2 * np.cumsum(psi**2))


def fit(y: np.ndarray, x: np.ndarray | None, order: tuple[int, int, int], seasonal: tuple[int, int, int], season: int) -> Fit:
    """Fits given orders; raises Degenerate where the parameters have no finite covariance."""
    (p, d, q), (P, _, Q) = order, seasonal
    design = np.hstack([np.ones((len(y), int(d == 0))), x if x is not None else np.empty((len(y), 0))])
    yd, xd = (np.diff(y), np.diff(design, axis=0)) if d else (y, design)
    beta = np.linalg.lstsq(xd, yd, rcond=None)[0] if xd.shape[1] else np.empty(0)
    skip, theta = min(p + P * season, len(yd) // 3), np.zeros(p + q + P + Q)

    def split(v: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(np.split(v, np.cumsum([p, q, P])))

    def residuals(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, b, A, B = split(v)
        return _invert(_poly(b, B, season, 1.0), _apply(_poly(a, A, season, -1.0), w))[skip:]

    def loss(v: np.ndarray, w: np.ndarray) -> float:
        a, b, A, B = split(v)
        if not (_steady(a, A) and _steady(-b, -B)):
            return 1e10
        e = residuals(v, w)
        return math.log(max(float(e @ e) / len(e), 1e-300))

    for _ in range(2 if xd.shape[1] else 1):
        w = yd - xd @ beta
        theta, value = nelder_mead(lambda v: loss(v, w), theta)
        if xd.shape[1]:
            filtered = np.column_stack([residuals(theta, c) for c in xd.T])
            beta = np.linalg.lstsq(filtered, residuals(theta, yd), rcond=None)[0]
    e = residuals(theta, yd - xd @ beta)
    sigma2 = float(e @ e) / len(e)
    a, b, A, B = split(theta)
    if not math.isfinite(sigma2) or sigma2 <= 0 or value >= 1e9:
        raise Degenerate(f"no finite fit for {order}x{seasonal}")
    k = len(theta) + len(beta) + 1
    n = len(e)
    aicc = n * (math.log(2 * math.pi * sigma2) + 1) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf)
    return Fit(order, seasonal, season, _poly(a, A, season, -1.0), _poly(b, B, season, 1.0), beta, sigma2, aicc, y, design)


def auto(y: np.ndarray, x: np.ndarray | None = None, season: int = 12) -> Fit:
    """The best fit by AICc over stepwise neighbours of four starts."""
    if len(y) < 3 * season or np.std(y) == 0:
        raise Degenerate("too short or constant")
    d, tried = int(needs_difference(y)), {}

    def get(p: int, q: int, P: int, Q: int) -> float:
        key = (p, q, P, Q)
        if min(key) < 0 or any(v > m for v, m in zip(key, BOX)):
            return math.inf
        if key not in tried:
            try:
                tried[key] = fit(y, x, (p, d, q), (P, 0, Q), season)
            except (Degenerate, np.linalg.LinAlgError):
                tried[key] = None
        return tried[key].aicc if tried[key] else math.inf

    now = min([(2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1)], key=lambda k: get(*k))
    while True:
        p, q, P, Q = now
        near = [(p + a, q + b, P, Q) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1))] + [(p, q, P + a, Q + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        best = min(near, key=lambda k: get(*k))
        if get(*best) >= get(*now):
            break
        now = best
    if not tried.get(now):
        raise Degenerate("no order could be fitted")
    return tried[now]
