"""SimHash near-duplicates over 64-bit fingerprints, found with a Gray-order hierarchical index.

Sorted by Gray rank, fingerprints that lie together share many bits. An index over a sorted run factors the bits that
all of a node's members share into that node (mask and pattern). Two nodes differ at least in the bits that both share
and that are unlike; these differences accumulate on the way down, and a pair of nodes with more of them than the
limit is dropped with all of its members.

Distribution: with ``blocks`` blocks of bits, two fingerprints at ``limit`` differences agree in at least
``blocks - limit`` blocks, so each fingerprint goes to one bucket for every choice of that many blocks (4 blocks and 2
differences: six 32-bit keys). Buckets are searched where they land; only a spanning forest of each partition's links
is emitted, never the pairs of a group, and the forests are merged by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, unused

FAN = 4


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles (repeats included) of a UTF-8 text; no words: zero."""
    words = text.lower().split()  # of bytes: only A-Z change and only ASCII white space separates
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return majority(np.array(list(map(xxhash.xxh64_intdigest, parts, repeat(seed))), dtype="<u8"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the binary reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (bucket, Gray rank); a node covers FAN nodes of the level below."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        order = np.lexsort((gray_rank(prints), keys))
        self.prints, self.keys = prints[order], keys[order]
        self.levels = [(self.prints, np.full(len(prints), ~np.uint64(0)), self.keys, self.keys)]
        while len(self.levels[-1][0]) > 1:
            pattern, mask, first, last = self.levels[-1]
            at = np.arange(0, len(pattern), FAN)
            top = np.repeat(pattern[at], FAN)[: len(pattern)]
            common = np.bitwise_and.reduceat(mask & ~(pattern ^ top), at)
            ends = np.minimum(at + FAN, len(pattern)) - 1
            self.levels.append((pattern[at] & common, common, first[at], last[ends]))

    def links(self, limit: int, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs a < b of one bucket with at most ``limit`` differing bits, in pieces."""
        if len(self.prints) < 2:
            return
        zero = np.zeros(1, dtype=np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        grid_a, grid_b = (x.ravel() for x in np.indices((FAN, FAN)))
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            if level == 0:
                keep = (a < b) & (self.keys[a] == self.keys[b])
                a, b = a[keep], b[keep]
                near = np.bitwise_count(self.prints[a] ^ self.prints[b]) <= limit
                if near.any():
                    yield a[near], b[near]
                continue
            pattern, mask, first, last = self.levels[level - 1]
            ca, cb = (a[:, None] * FAN + grid_a).ravel(), (b[:, None] * FAN + grid_b).ravel()
            keep = (ca <= cb) & (cb < len(pattern)) & (ca < len(pattern))
            ca, cb = ca[keep], cb[keep]
            keep = last[ca] >= first[cb]
            ca, cb = ca[keep], cb[keep]
            keep = np.bitwise_count((pattern[ca] ^ pattern[cb]) & mask[ca] & mask[cb]) <= limit
            if keep.any():
                stack.append((level - 1, ca[keep], cb[keep]))


def forest(keys: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each linked fingerprint with its tree's root."""
    index = GrayIndex(keys, prints)
    root = np.arange(len(prints))
    # The same fingerprint may stand in several buckets of this partition: one node for each distinct fingerprint.
    same = np.unique(index.prints, return_inverse=True)[1]
    first = np.full(same.max(initial=-1) + 1, len(prints))
    np.minimum.at(first, same, root)
    root = first[same]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in index.links(limit):
        while True:  # full compression, so that links inside a tree are dropped at once
            jumped = root[root]
            if (jumped == root).all():
                break
            root[:] = jumped
        apart = root[a] != root[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    while not (root[root] == root).all():
        root[:] = root[root]
    linked = np.flatnonzero(index.prints != index.prints[root]) if len(prints) else root
    return index.prints[linked], index.prints[root[linked]]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, print long) for every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(x or b"", width) for x in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


def links(prints: DataFrame, limit: int = 2, blocks: int = 4) -> DataFrame:
    """(a, b) edges that span every class of distinct fingerprints ``prints`` (column print) within ``limit`` bits."""
    size, chosen = 64 // blocks, list(combinations(range(blocks), blocks - limit))
    if 64 % blocks or limit >= blocks or size * (blocks - limit) > 48:
        raise ValueError("blocks must divide 64, exceed limit, and leave keys of at most 48 bits")

    def key(n: int, of: tuple[int, ...]):
        parts = [F.shiftleft(F.shiftrightunsigned("print", size * k).bitwiseAND((1 << size) - 1), size * i) for i, k in enumerate(of)]
        total = F.lit(n << 48)
        for p in parts:
            total = total.bitwiseOR(p)
        return total

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            keys, prints = (np.concatenate(x) for x in zip(*got))
            a, b = forest(keys, prints.view(np.uint64), limit)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keyed = prints.select(F.explode(F.array(*(key(n, of) for n, of in enumerate(chosen)))).alias("key"), "print")
    return keyed.repartition("key").mapInArrow(run, "a long, b long").distinct()


def classes(prints: DataFrame, limit: int = 2) -> DataFrame:
    """(print, root) for every different fingerprint: root names its class of linked fingerprints."""
    distinct = prints.select("print").distinct()
    joined = components(links(distinct, limit)).select(F.col("node").alias("print"), "root")
    return distinct.join(joined, "print", "left").select("print", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, limit: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, print, component_id) of every document: near-duplicate classes of SimHash fingerprints.

    Class: the connected component of fingerprints at ``limit`` or fewer differing bits; component_id is the smallest
    doc_id of the class (null only if all its ids are null). Null and empty texts have fingerprint zero and are linked
    like any other; repeated rows stay.
    """
    each = durable(fingerprints(docs, width))
    rooted = durable(each.groupBy("print").agg(F.min("doc_id").alias("least")).join(classes(each, limit), "print"))
    tops = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(rooted.join(tops, "root").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, limit: int = 2, width: int = 3) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id (nulls last), with all its columns."""
    row = unused(docs, "_row")
    numbered = durable(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so the numbers stay
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    each = durable(fingerprints(ids.select(F.col("row").alias("doc_id"), "text"), width).withColumnRenamed("doc_id", "row"))
    ranked = ids.select("row", "doc_id").join(each, "row").join(classes(each, limit), "print")
    first = ranked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return numbered.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op7_simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): classes at two or fewer differing bits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
