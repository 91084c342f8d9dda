"""Quality classifier: a generalised additive model with pairwise interactions.

Features are ratios of the whole text, binned by quantiles. Boosting cycles over the features: each step fits a shallow
tree to one feature's bins and adds it to that feature's lookup table, so no feature can hide another. Then the pairs
that explain most of what is left get tables of two features, again from cyclic shallow trees. A score is the sum of
one table entry per feature and pair, added for a whole batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, schema_of

FEATURES = ("log_words", "word_length", "longest_word", "distinct", "echo", "upper", "digits", "stops", "commas", "marks", "symbols", "wide", "log_lines", "line_words", "line_distinct", "capitals", "tails")


def _table(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(np.int64)


_KINDS = np.stack([_table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789"), _table(b".:;?"), _table(b","), _table(b"!"), _table(b"#$%&*+/<=>@[\\]^_`{|}~"), _table(bytes(range(128, 256)))]).T


def features(text: bytes) -> list[float]:
    """The model's inputs, of the whole text; an empty text gives zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    upper, lower, digits, stops, commas, marks, symbols, wide = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS).tolist()
    lengths = list(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    echo = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(n)), sum(lengths) / n, float(np.log1p(max(lengths))), len(set(words)) / n**0.9, echo / n, upper / (upper + lower + 1),
        digits / size, stops / n, commas / n, marks / n, symbols / n, wide / size, float(np.log1p(len(lines))), float(np.log1p(n / len(lines))),
        len(set(lines)) / len(lines), sum(map(bytes.istitle, words)) / n, sum(1 for x in words if not x[-1:].isalnum() and x[-1] < 128) / n,
    ]


def _leaves(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """Leaf values of a shallow regression tree over ordered bins with gradient and weight sums ``g`` and ``h``."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, depth: int) -> None:
        G, H = g[a:b].sum(), h[a:b].sum()
        if depth and b - a > 1:
            gl, hl = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge)
            cut = int(np.argmax(gain))
            if gain[cut] > G**2 / (H + ridge) + 1e-9:
                grow(a, a + cut + 1, depth - 1)
                grow(a + cut + 1, b, depth - 1)
                return
        out[a:b] = G / (H + ridge)

    grow(0, len(g), depth)
    return out


@dataclass
class AdditiveModel:
    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    base: float = 0.0
    mains: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    tables: list = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]) if len(x) else np.zeros((len(edges), 0), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if self.mains:
            fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
            for b, t in zip(fine, self.mains):
                total += t[b]
            for (i, j), t in zip(self.pairs, self.tables):
                total += t[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 6, rate: float = 0.1, ridge: float = 5.0, fine: int = 48, coarse: int = 12) -> AdditiveModel:
    """Fits the tables to labels 0/1; one class only (or no rows) gives its smoothed rate as a constant."""
    rate0 = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(base=float(np.log(rate0 / (1 - rate0))))
    if len(y) == 0 or y.min() == y.max():
        return model
    for out, n in ((model.edges, fine), (model.coarse, coarse)):
        out += [np.unique(np.quantile(x[:, j], np.arange(1, n) / n)) for j in range(x.shape[1])]
    at, rough = model.bins(x, model.edges), model.bins(x, model.coarse)
    model.mains = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, t in zip(at, model.mains):
            g, h = slopes()
            step = rate * _leaves(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), ridge, 2)
            t += step
            margin += step[b]
    g, h = slopes()
    sizes = [len(e) + 1 for e in model.coarse]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[i] * sizes[j] + rough[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    gains = {(i, j): (sums(i, j, g) ** 2 / (sums(i, j, h) + ridge)).sum() for i, j in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for turn in range(pair_rounds):
        for (i, j), t in zip(model.pairs, model.tables):
            g, h = slopes()
            G, H = sums(i, j, g), sums(i, j, h)
            if turn % 2:  # the first cut alternates between the two features
                G, H = G.T, H.T
            gl, hl = np.cumsum(G.sum(1))[:-1], np.cumsum(H.sum(1))[:-1]
            cut = int(np.argmax(gl**2 / (hl + ridge) + (G.sum() - gl) ** 2 / (H.sum() - hl + ridge))) + 1 if len(gl) else 0
            step = np.zeros_like(G)
            for part in (slice(0, cut), slice(cut, None)):
                if G[part].size:
                    step[part] = rate * _leaves(G[part].sum(0), H[part].sum(0), ridge, 1)
            step = step.T if turn % 2 else step
            t += step
            margin += step[rough[i], rough[j]]
    return model


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [features(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = pa.array(np.array(rows, dtype=np.float64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, len(FEATURES)), pa.int32()), flat)], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def least_hashed(rows: DataFrame, most: int, slots: int = 4096) -> DataFrame:
    """The rows with the least hashes of doc_id, at most ``most``: found by counting hash slots, so that no task sends
    more than is kept (a sorted limit would send ``most`` rows from every task)."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    total = rows.count()
    if total <= most:
        return rows
    reach = min(1.0, 2.0 * most / total)  # the slots divide the part of the hashes in which the limit falls
    counts = {r.slot: r.n for r in rows.where(share < reach).groupBy(F.floor(share / reach * slots).alias("slot")).agg(F.count("*").alias("n")).collect()}
    held = slot = 0
    while slot < slots and held + counts.get(slot, 0) <= most:
        held += counts.get(slot, 0)
        slot += 1
    return rows.where(share < reach * slot / slots)


def learn(table: DataFrame, labels: DataFrame, max_rows: int = 30000) -> AdditiveModel:
    """Fits to at most ``max_rows`` labelled rows that are not held out, chosen by a hash of the id.

    Rows of labels without id or label are ignored; of several labels of one id the largest counts.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    rows = durable(table.join(marks, "doc_id").select("doc_id", "x", "y"))
    chosen = least_hashed(rows, max_rows).select("x", "y", "doc_id").collect()
    chosen.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([r.x for r in chosen], dtype=np.float64).reshape(len(chosen), len(FEATURES))
    return fit(x, np.array([float(r.y > 0) for r in chosen]))


def with_score(docs: DataFrame, model: AdditiveModel, column: str = "quality_score") -> DataFrame:
    """``docs`` with the score of each text as one more column, in place of any of that name."""
    docs = docs.drop(column)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            scores = model.score(np.array([features(t or b"") for t in texts]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema_of(docs) + f", `{column}` double")


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a null id is not held out and never labelled."""
    table = durable(feature_table(docs))
    model = learn(table, labels)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
