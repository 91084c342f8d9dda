"""Benchmark decontamination: windows of a document that are within an edit distance of a benchmark item.

Texts are compared as lower-case words with one space between. A window of an item's size is embedded by CGK random
walks (Chakraborty, Goldenberg, Koucky 2016): a walk repeats or advances a character by a random bit that depends on the
step and the character, so two walks drift back together after an edit, and edit distance became Hamming distance. The
walk starts anew at every word, so that an edit disturbs its neighbourhood only. Bit-sampling LSH takes, in each
repetition, a few steps of the walk as the key of a band: one band for each word of the item. The windows at *every*
word of a document are looked up; those that share bands enough with an item, at about one offset, are candidates. How
many are enough follows, for the number of bands of the item, from the recall asked for and the share of bands that
``share`` edits leave alike, which is measured on edited items when the index is built. Items of few words have a band
at every byte instead, and so have the documents for them.

Candidates must share as many 3-grams with the item as the q-gram lemma demands of ``share`` edits, which drops none
that is near enough, and are verified exactly by bit-parallel edit distance over all of the window, widened on both
sides by the number of edits allowed.

The index of a block of items of bounded size travels to the tasks, a larger benchmark takes several passes; nothing is
shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACES = bytes(c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))
_PAD = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "array<struct<item_id:bigint,edits:int,start_word:int>>"


def normal(text: str | None) -> bytes:
    """Lower-case words of letters, digits and other scripts, by single spaces."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACES).split())


def edit_distance_in(pattern: bytes, text: bytes) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text`` (Myers 1999, on Python's long integers)."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        places[c] |= 1 << i
    up, down, score, best = ones, 0, m, m
    for c in text:
        eq = places.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(xh | up)) & ones, up & xh
        score += bool(plus & top) - bool(minus & top)
        best = min(best, score)
        plus, minus = (plus << 1) & ones, (minus << 1) & ones
        up, down = (minus | ~(xv | plus)) & ones, plus & xv
    return best


def edited(text: bytes, edits: int, random: np.random.Generator, kinds: str = "sid") -> bytes:
    """``text`` with so many random substitutions, insertions and deletions of letters."""
    out = bytearray(text)
    for _ in range(edits):
        kind, letter = kinds[random.integers(len(kinds))], 97 + int(random.integers(26))
        at = int(random.integers(max(len(out), 1)))
        if kind == "i" or not out:
            out.insert(at, letter)
        elif kind == "s":
            out[at] = letter
        else:
            del out[at]
    return bytes(out)


def _grams(text: np.ndarray) -> np.ndarray:
    """Numbers of 3-grams by hash; different ones may share a bin, which only raises what texts have in common."""
    t = text.astype(np.int64)
    codes = (t[:-2] * 7919 + t[1:-1] * 131 + t[2:] * 31) & 4095 if len(t) > 2 else t[:0]
    return np.bincount(codes, minlength=4096)


class Bands:
    """Bands of some items: keys of walks that start at each word (or byte) of an item, and where these stand."""

    def __init__(self, texts: list[bytes], numbers: list[int], fine: bool, share: float, recall: float, steps: int, sampled: int, repetitions: int, seed: int):
        self.fine, self.share = fine, share
        random = np.random.default_rng(seed)
        self.bits = random.integers(0, 2, (repetitions, steps, 256), dtype=np.uint8).astype(np.int32)
        self.sampled = [set(random.permutation(steps)[:sampled].tolist()) for _ in range(repetitions)]
        self.numbers = np.array(numbers, dtype=np.int64)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        flat, starts = self.joined(texts)
        at = self.starts(flat)
        of = np.searchsorted(starts, at, side="right") - 1
        self.tables, n = [], len(at)
        found = [self.keys(flat, at, r) for r in range(repetitions)]
        # A key that very many items share says little: an item keeps those of its rarest bands, twelve at least.
        often = np.zeros(n, dtype=np.int64)
        for keys in found:
            _, back, many = np.unique(keys, return_inverse=True, return_counts=True)
            often = np.maximum(often, many[back])
        by = np.lexsort((often, of))
        rank = np.empty(n, dtype=np.int64)
        rank[by] = np.arange(n) - np.searchsorted(of[by], of[by])
        kept = (often <= 16) | (rank < 12)
        self.bands = np.bincount(of[kept], minlength=len(texts))
        for keys in found:
            order = np.argsort(keys[kept], kind="stable")
            sorted_keys = keys[kept][order]
            filter = np.zeros(1 << 20, dtype=bool)
            filter[sorted_keys >> np.uint64(44)] = True
            self.tables.append((filter, sorted_keys, of[kept][order], (at - starts[of])[kept][order]))
        self.half = np.maximum(8, (share * self.sizes / 2).astype(np.int64))
        alike = self.measure(texts, random)
        self.needed = np.array([max([1, *(v for v in range(2, n + 1) if sum(comb(n, k) * alike**k * (1 - alike) ** (n - k) for k in range(v)) <= 1 - recall)]) for n in range(int(self.bands.max(initial=0)) + 1)])[self.bands]

    @staticmethod
    def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts one after the other with zeros between, and where each starts."""
        gap = b"\0" * _PAD
        starts = np.cumsum([_PAD] + [len(t) + _PAD for t in texts])[:-1].astype(np.int64)
        return np.frombuffer(gap + gap.join(texts) + gap, np.uint8), starts

    def starts(self, flat: np.ndarray) -> np.ndarray:
        inside = flat > 32
        if not self.fine:
            inside[1:] &= flat[:-1] <= 32
        return np.flatnonzero(inside).astype(np.int32)

    def keys(self, flat: np.ndarray, at: np.ndarray, repetition: int) -> np.ndarray:
        """Keys of the walks from the places ``at``: the characters at the sampled steps."""
        at, out = at.copy(), np.zeros(len(at), dtype=np.uint64)
        for step, bits in enumerate(self.bits[repetition]):
            chars = flat[at]
            if step in self.sampled[repetition]:
                out *= _ODD
                out += chars
            at += bits[chars]
        out ^= out >> np.uint64(31)
        out *= _ODD
        return out

    def measure(self, texts: list[bytes], random: np.random.Generator, items: int = 60, copies: int = 4) -> float:
        """The share of an item's bands that a copy of ``share`` edits has at about the same place, over some items."""
        some = [texts[i] for i in random.permutation(len(texts))[:items]]
        total = alike = 0
        for text in some:
            for _ in range(copies):
                a, b = (self.joined([t])[0] for t in (text, edited(text, int(self.share * len(text)), random)))
                x, y = self.starts(a), self.starts(b)
                hit = np.zeros(len(x), dtype=bool)
                for r in range(len(self.tables)):
                    same = self.keys(a, x, r)[:, None] == self.keys(b, y, r)
                    hit |= (same & (np.abs(x[:, None] - y) <= max(8, int(self.share * len(text) / 2)))).any(axis=1)
                total, alike = total + len(x), alike + int(hit.sum())
        return alike / total if total else 0.0

    def candidates(self, flat: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, first, last): where, in its text, windows may start that share bands enough with the item."""
        at = self.starts(flat)
        found = []
        for r, (filter, keys, items, offsets) in enumerate(self.tables):
            mine = self.keys(flat, at, r)
            here = np.flatnonzero(filter[mine >> np.uint64(44)])
            low, high = (np.searchsorted(keys, mine[here], side=side) for side in ("left", "right"))
            many = high - low
            entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found.append((np.repeat(at[here].astype(np.int64), many), items[entry], offsets[entry]))
        place, item, offset = (np.concatenate(x) for x in zip(*found))
        if not len(place):
            return []
        text = np.searchsorted(starts, place, side="right") - 1
        begin = place - offset - starts[text]
        bin = (begin + (1 << 30)) // self.half[item]
        # Each band of the item counts once in a bin and its neighbour.
        code = (text * len(self.sizes) + item) * (1 << 28) + bin
        by = np.lexsort((offset, code))
        code, offset, item, text, bin = code[by], offset[by], item[by], text[by], bin[by]
        fresh = np.concatenate([[True], (np.diff(code) != 0) | (np.diff(offset) != 0)])
        code, item, text, bin = code[fresh], item[fresh], text[fresh], bin[fresh]
        head = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
        votes = np.diff(np.concatenate([head, [len(code)]]))
        code, item, text, bin = code[head], item[head], text[head], bin[head]
        next = np.concatenate([np.where(np.diff(code) == 1, votes[1:], 0), [0]])
        enough = votes + next >= self.needed[item]
        out: list[tuple[int, int, int, int]] = []
        last = -2
        for c, t, k, b in zip(code[enough].tolist(), text[enough].tolist(), item[enough].tolist(), bin[enough].tolist()):
            half = int(self.half[k])
            first, end = b * half - (1 << 30), (b + 2) * half - (1 << 30)
            if c == last + 1:  # neighbouring bins are one place
                out[-1] = (t, k, out[-1][2], end)
            else:
                out.append((t, k, first, end))
            last = c
        return out


class Matcher:
    """One block of items, ready to be looked for."""

    def __init__(self, items: Sequence[tuple[int, str]], share: float = 0.2, recall: float = 0.98, steps: int = 14, sampled: int = 9, repetitions: int = 3, few: int = 10, seed: int = 11):
        kept = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.share, self.ids, self.texts = share, [i for i, _ in kept], [t for _, t in kept]
        self.counts = [_grams(np.frombuffer(t, np.uint8)).astype(np.int32) for t in self.texts]
        # Items that are shorter than a walk are looked for as they are.
        tiny = [k for k, t in enumerate(self.texts) if len(t) < steps]
        fine = [k for k, t in enumerate(self.texts) if len(t) >= steps and t.count(b" ") + 1 < few]
        rest = [k for k, t in enumerate(self.texts) if len(t) >= steps and t.count(b" ") + 1 >= few]
        self.tiny = [(k, b" " + self.texts[k] + b" ") for k in tiny]
        self.bands = [Bands([self.texts[k] for k in ks], ks, is_fine, share, recall, steps, sampled, repetitions, seed) for ks, is_fine in ((rest, False), (fine, True)) if ks]

    def matches(self, texts: Sequence[str | None], chunk: int = 1 << 21) -> list[list[tuple[int, int, int]]]:
        """For each text its (item id, edits, first word) with the fewest edits per item, the first of equal ones."""
        out: list[list] = []
        held, size = [], 0
        for text in texts:
            held.append(normal(text))
            size += len(held[-1])
            if size >= chunk:
                out += self._chunk(held)
                held, size = [], 0
        return out + self._chunk(held)

    def _chunk(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        out: list[dict] = [{} for _ in texts]
        if self.tiny:
            for n, text in enumerate(texts):
                padded = b" " + text + b" "
                for k, item in self.tiny:
                    at = padded.find(item)
                    if at >= 0:
                        out[n][k] = (0, padded.count(b" ", 0, at))
        flat, starts = Bands.joined(texts)
        for bands in self.bands:
            for n, j, first, last in bands.candidates(flat, starts):
                k = int(bands.numbers[j])
                text, item = texts[n], self.texts[k]
                slack = int(self.share * len(item))
                window = text[max(0, first - slack) : max(0, last) + len(item) + slack]
                best = out[n].get(k, (slack + 1, 0))[0]
                edits = 0 if item in window else self._edits(k, window)
                if edits < best:
                    begin = text.find(item, max(0, first - slack)) if edits == 0 else max(0, min(first + int(bands.half[j]), len(text)))
                    out[n][k] = (edits, text.count(b" ", 0, begin))
        return [sorted((self.ids[k], e, s) for k, (e, s) in found.items()) for found in out]

    def _edits(self, k: int, window: bytes) -> int:
        item = self.texts[k]
        most = int(self.share * len(item))
        common = int(np.minimum(self.counts[k], _grams(np.frombuffer(window, np.uint8))).sum())
        if common < len(item) - 2 - 3 * most:  # the q-gram lemma: each edit spoils three 3-grams at most
            return most + 1
        return edit_distance_in(item, window)


def with_matches(docs: DataFrame, items: DataFrame, keep: list[str], column: str = "benchmark_matches", block_bytes: int = 1 << 19, **settings) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the matches of each text with ``items`` (item_id, text).

    Items without text, words or id take no part; items shorter than 16 bytes are found verbatim only. Null and empty
    texts have no matches. Repeated rows and repeated items each count for themselves. A column named ``column`` is replaced.
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    keep = [c for c in keep if c != column]
    rest = [] if "text" in keep else ["text"]
    out, fields = docs.select(*(f"`{c}`" for c in (*keep, *rest))), None
    for block in range(blocks):
        held = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()]
        shipped = docs.sparkSession.sparkContext.broadcast(Matcher(held, **settings))
        last = block == blocks - 1
        fields = [f for f in out.schema.fields if f.name != column and not (last and f.name in rest)]

        def run(batches, shipped=shipped, names=tuple(f.name for f in fields)):
            matcher = shipped.value
            for batch in batches:
                found = matcher.matches(batch.column(batch.schema.get_field_index("text")).to_pylist())
                at = batch.schema.get_field_index(column)
                if at >= 0:
                    found = [[tuple(m.values()) for m in (old or [])] + new for old, new in zip(batch.column(at).to_pylist(), found)]
                kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start_word", pa.int32())]))
                rows = pa.array([[dict(zip(("item_id", "edits", "start_word"), m)) for m in x] for x in found], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), rows], [*names, column])

        out = out.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{column}` {MATCHES}")
    return out


def op1_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start_word): every document and item that it holds within 20 % edits."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_matches(docs, benchmark, ["doc_id"]).select("doc_id", F.explode("benchmark_matches").alias("m")).select("doc_id", "m.item_id", "m.edits", "m.start_word")
