"""A gated recurrent language model in NumPy with a class-factored softmax.

Symbols are frequent words, classes of other words and the end mark. The probability of a symbol is that of its class
times that in its class, so a token costs two small softmaxes. Training is truncated backpropagation through time over
parallel streams whose state runs on from window to window; scoring carries each document's state from its first token
to its end.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of ``x`` less a shift of each row, their sums, and the shifts: none where the numbers stay in range without."""
    ones = np.ones(x.shape[1], x.dtype)
    if x.max(initial=0) < 60:
        e = np.exp(x)
        total = e @ ones
        if total.min(initial=1) > 1e-25:
            return e, total, 0.0
    top = x.max(axis=1)
    e = np.exp(x - top[:, None])
    return e, e @ ones, top


class Gru:
    def __init__(self, mass: np.ndarray, hidden: int = 32, size: int = 64, seed: int = 5):
        """``mass``: prior weight of each symbol, most frequent first; ``size`` symbols make a class."""
        random = np.random.default_rng(seed)
        self.hidden, self.size, self.symbols = hidden, size, len(mass)
        classes = -(-len(mass) // size)
        prior = np.full(classes * size, -30.0)
        prior[: len(mass)] = np.log(mass / mass.sum())
        prior = prior.reshape(classes, size)
        total = np.logaddexp.reduce(prior, axis=1)
        scale = 1 / np.sqrt(hidden)
        self.p = {
            "E": random.normal(0, 0.1, (len(mass), 3 * hidden)),
            "b": np.concatenate([np.ones(hidden), np.zeros(2 * hidden)]),
            "U": random.normal(0, scale, (hidden, 3 * hidden)),
            "Wc": random.normal(0, 0.05, (hidden, classes)),
            "bc": total,
            "Wo": random.normal(0, 0.05, (classes, hidden, size)),
            "bo": prior - total[:, None],
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gated(self, name: str, rows: np.ndarray | None = None) -> np.ndarray:
        """The parameter's parts (of ``rows``) for the update gate, the reset gate and the candidate, each by itself: (3, row, unit).

        Those of the gates are halved, as ``cell`` takes them: 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2.
        """
        p = self.p[name] if rows is None else self.p[name].take(rows, axis=0)
        out = np.ascontiguousarray(p.reshape(-1, 3, self.hidden).transpose(1, 0, 2))
        out[:2] *= 0.5
        return out

    def inputs(self, rows: np.ndarray | None = None) -> np.ndarray:
        """What each symbol (of ``rows``) brings to the gates and the candidate, with their biases, ``gated``.

        To be read by ``take``: an index array would lay the result out by row, with the gates of a row side by side.
        """
        biases = self.p["b"].reshape(3, 1, -1) * np.array([0.5, 0.5, 1], self.p["b"].dtype)[:, None, None]
        out = self.gated("E", rows)
        out += biases
        return out

    def cell(self, a: np.ndarray, h: np.ndarray, weights: np.ndarray) -> tuple:
        """State after ``h`` with inputs ``a`` (gate, row, unit; overwritten), the update and reset gates, the candidate and its part of ``h``; ``weights``: U, ``gated``."""
        u = np.matmul(h, weights)
        gates = a[:2]
        gates += u[:2]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates
        c = r * u[2]
        c += a[2]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        return new, z, r, c, u[2]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        return self.cell(self.inputs().take(x, axis=1), h, self.gated("U"))

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the symbols ``y`` after states ``h``; with ``grads`` also the slope of their mean's negative.

        Within classes the rows lie together by class: only the products are made class by class.
        """
        p, of, at = self.p, y // self.size, y % self.size
        rows = np.arange(len(y))
        # A unit that is always 1 brings in the biases, and their slopes.
        h = np.concatenate([h, np.ones((len(y), 1), h.dtype)], axis=1)

        def slope(e: np.ndarray, total: np.ndarray, at: np.ndarray) -> np.ndarray:
            e *= (1 / (total * len(y)))[:, None]
            e[rows, at] -= 1 / len(y)
            return e

        logits = h @ np.concatenate([p["Wc"], p["bc"][None]])
        e, total, shift = _exps(logits)
        out = (logits[rows, of] - shift - np.log(total)).astype(np.float64)
        dh = None
        if grads is not None:
            d = slope(e, total, of)
            both = h.T @ d
            grads["Wc"], grads["bc"], dh = both[:-1], both[-1], d @ p["Wc"].T
        order = np.argsort(of.astype(np.uint16) if len(p["bc"]) <= 1 << 16 else of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(p["bc"]) + 1))
        parts = [(k, slice(cuts[k], cuts[k + 1])) for k in np.flatnonzero(np.diff(cuts)).tolist()]
        h, at = h.take(order, axis=0), at[order]
        weights = np.concatenate([p["Wo"], p["bo"][:, None]], axis=1)
        inner = np.empty((len(y), self.size), logits.dtype)
        for k, mine in parts:
            np.matmul(h[mine], weights[k], out=inner[mine])
        e, total, shift = _exps(inner)
        out[order] += inner[rows, at] - shift - np.log(total)
        if grads is not None:
            d, back, both = slope(e, total, at), np.empty((len(y), self.hidden), inner.dtype), np.zeros_like(weights)
            for k, mine in parts:
                np.matmul(h[mine].T, d[mine], out=both[k])
                np.matmul(d[mine], p["Wo"][k].T, out=back[mine])
            grads["Wo"], grads["bo"] = both[:, :-1], both[:, -1]
            place = np.empty_like(order)
            place[order] = rows
            dh += back.take(place, axis=0)
        return out, dh

    def slopes(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, end: int) -> tuple[dict, np.ndarray]:
        """Slopes of the mean loss of a window of streams: symbols ``x`` read and ``y`` expected (step, stream), and the state after it.

        Backpropagation is truncated at the window; the state ``h`` runs on, but for documents that begin.
        """
        n, p = self.hidden, self.p
        (window, streams), kind = x.shape, p["U"].dtype
        ends = [np.flatnonzero(row == end) for row in x]
        seen, number = np.zeros(self.symbols, bool), np.empty(self.symbols, np.int64)
        seen[x] = True
        rows = np.flatnonzero(seen)
        number[rows] = np.arange(len(rows))
        number = number[x]
        inputs, weights = self.inputs(rows).take(number, axis=1), self.gated("U")
        before, states, c, un = (np.empty((window, streams, n), kind) for _ in range(4))
        for t in range(window):
            before[t] = h
            before[t][ends[t]] = 0
            h, _, _, c[t], un[t] = self.cell(inputs[:, t], before[t], weights)
            states[t] = h
        g: dict = {"rows": rows}
        _, dout = self.output(states.reshape(-1, n), y.ravel(), g)
        dout = dout.reshape(window, streams, n)
        # The gates now lie in ``inputs``; what does not depend on later steps is computed for all of them at once.
        z, r, rest = inputs[0], inputs[1], 1 - inputs[0]
        to_z = before - c
        to_z *= z
        to_z *= rest
        to_c = 1 - c * c
        to_c *= rest
        un *= r
        to_r = un * (1 - r)
        dh, back = np.zeros((streams, n), kind), np.ascontiguousarray(p["U"].reshape(n, 3, n).transpose(1, 2, 0))
        slopes, candidate = np.empty((3, window, streams, n), kind), np.empty((window, streams, n), kind)
        for t in range(window - 1, -1, -1):
            d = dh + dout[t]
            np.multiply(d, to_z[t], out=slopes[0, t])
            dc = np.multiply(d, to_c[t], out=slopes[2, t])
            np.multiply(dc, to_r[t], out=slopes[1, t])
            np.multiply(dc, r[t], out=candidate[t])
            dh = candidate[t] @ back[2]
            dh += slopes[0, t] @ back[0]
            dh += slopes[1, t] @ back[1]
            d *= z[t]
            dh += d
            dh[ends[t]] = 0
        past, flat = before.reshape(-1, n).T, slopes.reshape(3, -1, n)
        g["U"] = np.concatenate([past @ flat[0], past @ flat[1], past @ candidate.reshape(-1, n)], axis=1)
        cells = (number.reshape(-1, 1) * n + np.arange(n)).ravel()
        sums = np.zeros((3, len(rows) * n), kind)
        for total, part in zip(sums, flat):
            np.add.at(total, cells, part.ravel())
        g["E"] = np.concatenate(list(sums.reshape(3, -1, n)), axis=1)
        g["b"] = g["E"].sum(axis=0)
        return g, h

    def train(self, docs: Iterable[np.ndarray], end: int, streams: int = 256, window: int = 16, rate: float = 0.05, clip: float = 1.0, held: int = 1 << 20) -> int:
        """One reading of the documents (symbol arrays that close with ``end``), by Adagrad; returns the number of tokens.

        They are laid side by side in parallel streams, some ``held`` tokens at a time.
        """
        memory = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}
        total, waiting, size = 0, [], 0

        def read() -> None:
            y = np.concatenate(waiting)
            mine = max(1, min(streams, len(y) // window))
            width = -(-len(y) // mine)
            y = np.concatenate([y, np.full(width * mine - len(y), end)]).reshape(mine, width)
            x = np.concatenate([np.full((mine, 1), end), y[:, :-1]], axis=1)  # the end mark also opens a document
            h = np.zeros((mine, self.hidden), dtype=np.float32)
            for at in range(0, width, window):
                g, h = self.slopes(np.ascontiguousarray(x[:, at : at + window].T), np.ascontiguousarray(y[:, at : at + window].T), h, end)
                rows = g.pop("rows")
                norm = float(np.sqrt(sum(float(np.vdot(v, v)) for v in g.values())))
                factor = min(1.0, clip / (norm + 1e-9))
                for k, v in g.items():
                    if factor < 1:
                        v *= factor
                    if k == "E":
                        past = memory[k].take(rows, axis=0)
                        past += v * v
                        memory[k][rows] = past
                        v /= np.sqrt(past)
                        v *= rate
                        self.p[k][rows] -= v
                    else:
                        memory[k] += v * v
                        v /= np.sqrt(memory[k])
                        v *= rate
                        self.p[k] -= v

        for doc in docs:
            if len(doc):
                waiting.append(doc.astype(np.int64))
                size += len(doc)
                if size >= held:
                    read()
                    total, waiting, size = total + size, [], 0
        if waiting:
            read()
        return total + size

    def packed(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].astype(np.float32).reshape(self.p[k].shape)
            at += self.p[k].size

    def score(self, docs: list[np.ndarray], end: int, window: int = 32, together: int = 2048, held: int = 1 << 13) -> np.ndarray:
        """Natural log-probability of each whole document (symbol arrays that close with ``end``); outputs of some ``held`` tokens at a time."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        out, inputs, weights = np.zeros(len(docs)), self.inputs(), self.gated("U")
        for begin in range(0, len(order), together):
            mine = order[begin : begin + together]
            length = sizes[mine]
            flat, starts = np.concatenate([docs[k] for k in mine]), np.cumsum(length) - length
            h, down = np.zeros((len(mine), self.hidden), dtype=np.float32), -length
            last = np.full(len(mine), end)
            for at in range(0, int(length[0]) if len(length) else 0, window):
                n = int(np.searchsorted(down, -at, side="left"))
                block = flat[np.minimum(starts[:n] + np.arange(at, at + window)[:, None], len(flat) - 1)]  # what lies beyond a document's end is not used
                states, targets, owners, size = [], [], [], 0
                steps = min(window, int(length[0]) - at)
                for t in range(steps):
                    n = int(np.searchsorted(down, -(at + t), side="left"))
                    h = self.cell(inputs.take(last[:n], axis=1), h[:n], weights)[0]
                    last = block[t, :n]
                    states.append(h)
                    targets.append(last)
                    owners.append(mine[:n])
                    size += n
                    if size >= held or t == steps - 1:
                        found, _ = self.output(np.concatenate(states), np.concatenate(targets))
                        out += np.bincount(np.concatenate(owners), found, len(out))
                        states, targets, owners, size = [], [], [], 0
        return out
