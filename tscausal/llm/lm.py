"""Language-model scores of documents: an add-half unigram base and a gated recurrent model.

Counts of all training tokens are gathered with Spark; the vocabulary grows with the corpus and is never collected.
A bounded number of frequent words travels to the tasks, the rest of each document's words meets its counts in a join.

The recurrent model learns from all training documents: every task reads its own by truncated backpropagation from the
same weights, the weights are averaged by tokens in a tree of tasks, and the next, larger share of the documents goes on
from there. A corpus of few tokens is read several times over.

The model predicts symbols: the most frequent words, the end mark, and classes of all other words by ending
and trailing mark. A word of a class has its share of the class's mass in the base model, so every text has a
probability, also with words that training never saw:
log p(word) = log p(symbol | history) - log base(symbol) + log base(word).
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release
from .gru import Gru

TRAILING = b".,!#$%*&|;:"
ENDINGS = 16
CLASSES = (len(TRAILING) + 1) * ENDINGS


def class_of(word: bytes) -> int:
    """Class of a word without a symbol of its own: by its trailing mark and its last two bytes before the marks."""
    stem = word.rstrip(TRAILING)
    return (TRAILING.find(word[len(stem) : len(stem) + 1]) + 1 if len(stem) < len(word) else 0) * ENDINGS + zlib.crc32(stem[-2:]) % ENDINGS


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte the place of a trailing mark, from 1 (0: none); the last part of ``class_of`` by the one or two last bytes of a stem."""
    marks = np.array([TRAILING.find(bytes([b])) + 1 for b in range(256)])
    one = np.array([zlib.crc32(bytes([b])) % ENDINGS for b in range(256)])
    return marks, one, np.array([zlib.crc32(bytes([a, b])) % ENDINGS for a in range(256) for b in range(256)])


def classes_of(words: pa.Array) -> np.ndarray:
    """``class_of`` of each of the words (binary or string)."""
    if not len(words):
        return np.zeros(0, np.int64)
    marks, one, two = _tables()
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(1, np.uint8)
    begin, end = offsets[:-1], offsets[1:]
    stem, left = end.copy(), np.arange(len(words))
    for _ in range(8):
        left = left[stem[left] > begin[left]]
        left = left[marks[data[stem[left] - 1]] > 0]
        stem[left] -= 1
    mark = np.where(stem < end, marks[data[np.minimum(stem, len(data) - 1)]], 0)
    last, before = data[np.maximum(stem - 1, 0)].astype(np.int64), data[np.maximum(stem - 2, 0)].astype(np.int64)
    ending = np.select([stem - begin > 1, stem - begin == 1], [two[before * 256 + last], one[last]], zlib.crc32(b"") % ENDINGS)
    out = mark * ENDINGS + ending
    for i in left.tolist():  # more marks than were looked at
        out[i] = class_of(data[begin[i] : end[i]].tobytes())
    return out


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts (string) one after another, without end marks, and the place of the text each is of."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, of = parts.flatten(), np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    full = pc.not_equal(pc.binary_length(words), 0)  # outer white space leaves empty parts
    if not pc.all(full).as_py():
        words, of = words.filter(full), of[full.to_numpy(zero_copy_only=False)]
    return words, of


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 1, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """(token binary, c long) over all texts (column text)."""

    def run(batches):
        for batch in batches:
            found = pc.value_counts(tokens_of(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field(0).view(pa.binary()), found.field(1)], ["token", "c"])

    return texts.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def class_masses(counts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Base mass (count + 1/2 each, and 1/2 for unseen words) of the classes over all words but ``words``."""
    shipped = counts.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))

    def run(batches):
        for batch in batches:
            tokens = batch.column(0).cast(pa.binary())
            mine = pc.invert(pc.is_in(tokens, value_set=shipped.value))
            mass = np.bincount(classes_of(tokens.filter(mine)), batch.column(1).filter(mine).to_numpy(zero_copy_only=False) + 0.5, CLASSES)
            at = np.flatnonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mass[at])], ["k", "mass"])

    out = np.full(CLASSES, 0.5)
    for row in counts.select("token", "c").mapInArrow(run, "k long, mass double").groupBy("k").agg(F.sum("mass").alias("mass")).collect():
        out[row.k] += row.mass
    return out


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of the largest counts, as many whole counts as give at most ``most`` words."""
    down = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    sizes = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(down)).where(F.col("n") <= most)
    least = sizes.agg(F.min("c")).first()[0]  # one row per different count
    return counts.where(F.col("c") >= least) if least else counts.where("false")


class Symbols:
    """Numbers of the symbols, most mass first, and what the base model needs of the frequent words."""

    def __init__(self, frequent: list[tuple[bytes, int]], own: int, masses: np.ndarray, n_docs: int, n_tokens: int, n_types: int):
        self.total = n_tokens + 0.5 * (n_types + 1)
        named = [(c + 0.5, 0, w) for w, c in frequent[:own]] + [(m, 1, k) for k, m in enumerate(masses.tolist())] + [(n_docs + 0.5, 2, None)]
        named.sort(key=lambda x: -x[0])
        self.mass = np.array([m for m, _, _ in named])
        self.log_base = np.log10(self.mass / self.total)
        self.words = {w: i for i, (_, kind, w) in enumerate(named) if kind == 0}
        self.classes = np.zeros(CLASSES, dtype=np.int64)
        for i, (_, kind, k) in enumerate(named):
            if kind == 1:
                self.classes[k] = i
            elif kind == 2:
                self.end = i
        self.end_base, self.end_known = float(np.log10((n_docs + 0.5) / self.total)), int(n_docs > 0)
        # One lookup per word: place of a frequent word, and by place its symbol and base log-probability.
        self.frequent = pa.array([w for w, _ in frequent], pa.binary())
        self.symbol_at = np.array([self.words[w] if w in self.words else self.classes[class_of(w)] for w, _ in frequent], dtype=np.int64)
        self.log_at = np.log10((np.array([c for _, c in frequent], dtype=np.float64) + 0.5) / self.total)

    def read(self, texts: pa.Array) -> dict:
        """What ``coded`` gives of each text, and under ``rare`` the other words: the place of the text, word and times."""
        words, of = tokens_of(texts)
        n, words = len(texts), words.view(pa.binary())
        at = pc.fill_null(pc.index_in(words, value_set=self.frequent), -1).to_numpy(zero_copy_only=False)
        known = at >= 0
        other = words.filter(pa.array(~known)).dictionary_encode()
        kinds, which, theirs = other.dictionary, other.indices.to_numpy(zero_copy_only=False), of[~known]
        mine = np.empty(len(at), np.int64)
        mine[known], mine[~known] = self.symbol_at[at[known]], self.classes[classes_of(kinds)][which]
        pairs, times = np.unique(theirs * max(len(kinds), 1) + which, return_counts=True)
        sizes = np.bincount(of, minlength=n) + 1
        codes = np.full(len(at) + n, self.end, "<u2")
        codes[np.arange(len(at)) + of] = mine
        return {
            "n_tokens": sizes, "known": np.bincount(of[known], minlength=n) + self.end_known,
            "base": np.bincount(of[known], self.log_at[at[known]], n) + self.end_base,
            "plain": np.bincount(of, self.log_base[mine], n) + self.log_base[self.end],
            "codes": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, 2 * np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(codes)]),
            "rare": (pairs // max(len(kinds), 1), kinds.take(pa.array(pairs % max(len(kinds), 1))), times),
        }


def coded(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """(doc_id, held_out, key, size, n_tokens, known, base, plain, codes, token, times) of ``docs``: a row for each document, and one for each of its rare words.

    ``codes`` are the symbols as 16-bit numbers, ``plain`` the base log10 probability of the symbols.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(symbols)
    names = ["doc_id", "held_out", "key", "size", "n_tokens", "known", "base", "plain", "codes", "token", "times"]

    def run(batches):
        symbols = shipped.value
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            found = symbols.read(batch.column(4))
            of, rare, times = found["rare"]
            blank, gap = lambda kind: pa.nulls(len(of), kind), lambda kind: pa.nulls(batch.num_rows, kind)
            columns = [
                *(pa.concat_arrays([batch.column(i), blank(batch.column(i).type)]) for i in (0, 1)),
                *(pa.concat_arrays([batch.column(i), batch.column(i).take(pa.array(of))]) for i in (2, 3)),
                *(pa.concat_arrays([pa.array(found[x], kind), blank(kind)]) for x, kind in (("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("plain", pa.float64()))),
                pa.concat_arrays([found["codes"], blank(pa.binary())]),
                pa.concat_arrays([gap(pa.binary()), rare]), pa.concat_arrays([gap(pa.int64()), pa.array(times, pa.int64())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    shape = "doc_id long, held_out boolean, key long, size int, n_tokens long, known long, base double, plain double, codes binary, token binary, times long"
    return docs.select("doc_id", "held_out", "key", "size", "text").mapInArrow(run, shape)


def _averaged(models: DataFrame, fan: int = 16, most: int = 8) -> np.ndarray | None:
    """The mean of ``models`` (tokens, flat), weighted by tokens, through a tree of tasks; at most ``most`` rows reach the driver."""

    def add(batches):
        total, flat = 0, 0.0
        for batch in batches:
            for n, bytes_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, flat = total + n, flat + n * np.frombuffer(bytes_, "<f4").astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(flat / total).astype("<f4").tobytes()], pa.binary())], ["tokens", "flat"])

    models = durable(models)
    n = models.count()
    while n > most:
        n, last = -(-n // fan), models
        models = durable(last.repartition(n).mapInArrow(add, "tokens long, flat binary"))
        release(last)
    rows = sorted(((r.tokens, bytes(r.flat)) for r in models.collect()), reverse=True)
    release(models)
    total = sum(n for n, _ in rows)
    return sum(n * np.frombuffer(f, "<f4").astype(np.float64) for n, f in rows) / total if total else None


def fit(training: DataFrame, model: Gru, end: int, n_tokens: int, shares: tuple[int, ...] = (1, 3, 12), least_tokens: int = 4_000_000) -> None:
    """Fits ``model`` to all of ``training`` (codes), share after share; a corpus under ``least_tokens`` is read as often as makes that many."""
    times = -(-least_tokens // max(n_tokens, 1))
    shares = shares if times == 1 else (sum(shares),)
    spark, low = training.sparkSession, 0
    for share in shares:
        shipped = spark.sparkContext.broadcast(model)

        def run(batches, shipped=shipped):
            mine = Gru.__new__(Gru)
            mine.__dict__ = shipped.value.__dict__ | {"p": {k: v.copy() for k, v in shipped.value.p.items()}}
            docs = (np.frombuffer(x, "<u2") for batch in batches for x in batch.column(0).to_pylist())
            if times > 1:
                kept = list(docs)
                docs = (kept[i] for t in range(times) for i in np.random.default_rng(t).permutation(len(kept)))
            if tokens := mine.train(docs, end):
                yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([mine.packed().astype("<f4").tobytes()], pa.binary())], ["tokens", "flat"])

        part = F.pmod(F.xxhash64("key", "size", F.lit(9)), F.lit(sum(shares)))
        flat = _averaged(training.where((part >= low) & (part < low + share)).select("codes").mapInArrow(run, "tokens long, flat binary"))
        if flat is not None:
            model.unpack(flat)
        low += share


def model_scores(docs: DataFrame, frequent_words: int = 100_000, own_symbols: int = 3900, hidden: int = 32) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    Documents whose crc32(doc_id) mod 5 is 1 are held out of all learning; a null id is not held out. Null and empty
    texts consist of the end token, very long ones are read whole. Without training texts both models give an unseen
    token probability 1. Counts and the recurrent model are learned from all training documents, repeated rows as often
    as they stand. Equal texts get equal scores.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held_out().alias("held_out"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("size"))
    training = docs.where("NOT held_out")
    counts = durable(word_counts(training))
    n_docs = training.count()
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_tokens, n_types = n_words + n_docs, n_types + (n_docs > 0)
    frequent = sorted(((bytes(r.token), r.c) for r in most_frequent(counts, frequent_words).collect()), key=lambda x: (-x[1], x[0]))
    symbols = Symbols(frequent, own_symbols, class_masses(counts, [w for w, _ in frequent[:own_symbols]]), n_docs, n_tokens, n_types)
    passed = durable(coded(docs, symbols))
    rows, rare = passed.where("token IS NULL").drop("token", "times"), passed.where("token IS NOT NULL").select("key", "size", "token", "times")
    model = Gru(symbols.mass, hidden)
    if n_docs:
        fit(rows.where("NOT held_out"), model, symbols.end, n_tokens)
    shipped = spark.sparkContext.broadcast(model)
    end, names = symbols.end, ["doc_id", "held_out", "key", "size", "n_tokens", "known", "base", "gain"]

    def run(batches):
        for batch in (b.slice(at, 5000) for b in batches for at in range(0, b.num_rows, 5000)):
            codes = [np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(8).to_pylist()]
            gain = shipped.value.score(codes, end) / np.log(10) - batch.column(7).to_numpy() if n_docs else np.zeros(len(codes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(gain)], names)

    shape = "doc_id long, held_out boolean, key long, size int, n_tokens long, known long, base double, gain double"
    rows = durable(rows.select(*names[:7], "plain", "codes").mapInArrow(run, shape))
    met = rare.join(counts, "token", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / symbols.total)
    found = met.groupBy("key", "size").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"))
    # Copies of a text have sent their rare words each; every copy gets its part.
    copies = rows.groupBy("key", "size").agg(F.count("*").alias("copies"))
    found = durable(found.join(copies, ["key", "size"]).select("key", "size", (F.col("more") / F.col("copies")).alias("more"), F.expr("more_known div copies").alias("more_known")))
    release(passed, counts)
    rows = rows.join(found, ["key", "size"], "left").withColumn("base_score", F.col("base") + F.coalesce("more", F.lit(0.0)))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", (F.col("base_score") + F.col("gain")).alias("score"))


def op9_lm(docs: DataFrame) -> DataFrame:
    """``model_scores`` with production parameters."""
    return model_scores(docs)
