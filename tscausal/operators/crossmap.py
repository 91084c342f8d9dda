"""Edge tests by cross mapping with surrogates, one NumPy call per directed edge.

The neighbours of a point and their weights depend on the effect alone. A test therefore finds them once per lag and
applies them to the observed cause and to all surrogates in one product, instead of searching again for each surrogate.
Surrogates are made in one batch.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..params import DEFAULT, Params
from .stats import kendall

EDGE = (
    "cause string, effect string, status string, obs_lag int, obs_rho double, obs_n long, p_value double, null_mean double, null_std double, "
    "n_valid_surrogates int, convergence_diagnostic_pass boolean, kendall_tau double, kendall_p double"
)


def vectors(effect: np.ndarray, lag: int, size: int, tau: int) -> np.ndarray:
    """Row t: effect at t + lag, t + lag - tau, …; NaN outside."""
    n = len(effect)
    out = np.full((n, size), np.nan)
    for k in range(size):
        at = np.arange(n) + lag - k * tau
        ok = (at >= 0) & (at < n)
        out[ok, k] = effect[at[ok]]
    return out


def weights_of(d: np.ndarray) -> np.ndarray:
    """Weights of rows of ascending neighbour distances."""
    least = d[:, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.maximum(np.exp(-d / least), 1e-6)
    return np.where(least == 0, np.where(d == 0, 1.0, 1e-6), w)


def distances(v: np.ndarray) -> np.ndarray:
    d = np.zeros((len(v), len(v)))
    for k in range(v.shape[1]):
        d += (v[:, k, None] - v[None, :, k]) ** 2
    d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    return d


def nearest(d: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` least values of each row, ties by column."""
    if d.shape[1] > 4 * count:
        some = np.sort(np.argpartition(d, count + 4, axis=1)[:, : count + 5], axis=1)
        near = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
        # Equal distances at the edge could have been cut by chance: those rows are sorted in full.
        edge = np.take_along_axis(d, near[:, -1:], 1)[:, 0]
        odd = np.take_along_axis(d, near[:, count - 1 : count], 1)[:, 0] == edge
        near = near[:, :count]
        if odd.any():
            near[odd] = np.argsort(d[odd], axis=1, kind="stable")[:, :count]
        return near
    return np.argsort(d, axis=1, kind="stable")[:, :count]


def correlation(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Pearson correlation of the columns of two arrays; NaN without variance."""
    y, p = y - y.mean(axis=0), p - p.mean(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (y * p).sum(axis=0) / np.sqrt((y * y).sum(axis=0) * (p * p).sum(axis=0))


def skills(cause: np.ndarray, effect: np.ndarray, lag: int, size: int, tau: int) -> tuple[np.ndarray, int]:
    """Skill for each column of ``cause`` (observed first, surrogates after, NaN at the same places), and the number of points."""
    v = vectors(effect, lag, size, tau)
    rows = np.flatnonzero(~np.isnan(v).any(axis=1) & ~np.isnan(cause[:, 0]))
    if len(rows) < max(20, size + 5):
        return np.full(cause.shape[1], np.nan), 0
    d = distances(v[rows])
    near = nearest(d, size + 1)
    w = weights_of(np.take_along_axis(d, near, 1))
    w /= w.sum(axis=1, keepdims=True)
    y = cause[rows]
    predicted = np.zeros_like(y)
    for k in range(size + 1):
        predicted += w[:, k, None] * y[near[:, k]]
    return correlation(y, predicted), len(rows)


def surrogates(x: np.ndarray, count: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """``count`` rows with the values of ``x`` and nearly its spectrum (IAAFT, Schreiber and Schmitz 1996)."""
    ordered, amplitude = np.sort(x), np.abs(np.fft.rfft(x))
    out = np.stack([random.permutation(x) for _ in range(count)]) if count else np.empty((0, len(x)))
    for _ in range(rounds):
        phases = np.fft.rfft(out, axis=1)
        size = np.abs(phases)
        wave = np.fft.irfft(amplitude * np.divide(phases, size, out=np.ones_like(phases), where=size > 0), n=len(x), axis=1)
        ranks = np.empty(wave.shape, dtype=np.int64)
        np.put_along_axis(ranks, np.argsort(wave, axis=1), np.arange(len(x))[None, :], axis=1)
        out = ordered[ranks]
    return out


def convergence(cause: np.ndarray, effect: np.ndarray, lag: int, size: int, tau: int, samples: int = 50, seed: int = 1) -> list[tuple[int, float]]:
    """(library size, mean skill over random libraries), from a third of the points to all but one."""
    v = vectors(effect, lag, size, tau)
    rows = np.flatnonzero(~np.isnan(v).any(axis=1) & ~np.isnan(cause))
    n = len(rows)
    stop, start = n - 1, max(10, size + 2, (n - 1) // 3)
    if n < 30 or start >= stop:
        return []
    d, y, random, out = distances(v[rows]), cause[rows], np.random.default_rng(seed), []
    for library in range(start, stop + 1, max(5, (stop - start) // 8)):
        found = []
        for _ in range(samples):
            mine = np.sort(random.choice(n, library, replace=False))
            part = d[:, mine]
            near = nearest(part, size + 1)
            w = weights_of(np.take_along_axis(part, near, 1))
            found.append(correlation(y[:, None], ((w * y[mine[near]]).sum(axis=1) / w.sum(axis=1))[:, None])[0])
        out.append((library, float(np.nanmean(found))))
    return out


def edge_seed(cause: str, effect: str) -> int:
    return int(hashlib.md5(f"{cause}|{effect}".encode()).hexdigest()[:8], 16)


def edge_record(x: np.ndarray, y: np.ndarray, cause: str, effect: str, size: int, tau: int, params: Params = DEFAULT) -> dict:
    """The record of one directed edge; ``x`` and ``y`` are cause and effect on the same complete calendar."""
    record = {"cause": cause, "effect": effect}
    profile = [(lag, *(f(v) for f, v in zip((lambda r: r[0], int), skills(x[:, None], y, lag, size, tau)))) for lag in params.lags]
    usable = [(rho, -i, lag, n) for i, (lag, rho, n) in enumerate(profile) if not math.isnan(rho)]
    if not usable:
        return record | {"status": "insufficient_data"}
    rho, _, lag, n = max(usable)
    record |= {"obs_lag": lag, "obs_rho": float(rho), "obs_n": n}
    seen = ~np.isnan(x)
    if seen.sum() < 30:
        return record | {"status": "insufficient_cause_observations"}
    null = np.full((len(x), params.surrogates), np.nan)
    null[seen] = surrogates(x[seen], params.surrogates, params.surrogate_rounds, np.random.default_rng(edge_seed(cause, effect))).T
    best = np.full(params.surrogates, np.nan)
    for at, _, points in profile:
        if points:
            best = np.fmax(best, skills(null, y, at, size, tau)[0])
    valid = best[~np.isnan(best)]
    record["n_valid_surrogates"] = len(valid)
    if len(valid) < 0.5 * params.surrogates:
        return record | {"status": "insufficient_surrogates"}
    curve = [(s, r) for s, r in convergence(x, y, lag, size, tau) if not math.isnan(r)]
    t, p = kendall([s for s, _ in curve], [r for _, r in curve]) if len(curve) >= 4 else (math.nan, math.nan)
    return record | {
        "status": "OK", "p_value": float(((valid >= rho).sum() + 1) / (len(valid) + 1)), "null_mean": float(valid.mean()), "null_std": float(valid.std()),
        "convergence_diagnostic_pass": bool(len(curve) >= 4 and curve[-1][1] > 0 and t > 0 and p < 0.05),
        "kendall_tau": None if math.isnan(t) else t, "kendall_p": None if math.isnan(p) else p,
    }


def edge_tests(pairs: DataFrame, by: list[str], pos: str, params: Params = DEFAULT) -> DataFrame:
    """Tests every edge of ``pairs`` (by, cause, effect, size, tau, pos, x, y): one group and one task per edge."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*by).schema) + ", " + EDGE
    names = [part.split()[0] for part in shape.split(", ")]

    def run(frame):
        frame = frame.sort_values(pos)
        head = frame.iloc[0]
        x, y = (frame[c].to_numpy(dtype=np.float64) for c in ("x", "y"))
        record = {b: head[b] for b in by} | edge_record(x, y, head["cause"], head["effect"], int(head["size"]), int(head["tau"]), params)
        out = pd.DataFrame([{name: record.get(name) for name in names}])
        return out.astype({"obs_lag": "Int32", "obs_n": "Int64", "n_valid_surrogates": "Int32", "convergence_diagnostic_pass": "boolean", **{c: "Float64" for c in ("obs_rho", "p_value", "null_mean", "null_std", "kendall_tau", "kendall_p")}})

    return pairs.groupBy(*by, "cause", "effect").applyInPandas(run, shape)
