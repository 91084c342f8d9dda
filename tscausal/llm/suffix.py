"""Removal of long repeated strings with suffix arrays built by linear grouping.

A byte goes if a ``length``-byte string that covers it also starts anywhere else. Three steps:

*Routing.* Of the gram starts inside a window of ``length`` bytes the one with the least hash is its anchor, so equal
windows have equal anchor grams. The windows of a document that share an anchor are a run; the run's bytes (a segment)
hold all of them. Equal windows can only lie in segments of the same anchor gram, and only grams that occur twice matter.

*Suffix arrays.* The different segments of a gram (equal ones once, with their number) are sorted by a suffix array;
windows that occur again stand side by side in it. The construction is the linear one of Baier (2016): suffixes are
grouped by their Lyndon prefix. Groups are processed in descending order; each member points to the nearest smaller
suffix on its left, and suffixes that were pointed to split off their group by the number of members pointing at them,
for their Lyndon prefix grew by that many copies. Then one ascending pass emits each group's order from the next smaller
suffixes; nothing is renamed or doubled. The arrays of many grams are built in lock step with NumPy.

*Removal.* Runs of repeated windows go back to their documents and are merged into spans.

A gram with very many different segments is split further: windows at the same distances before the anchor share the
bytes between them, and these bytes' hash is the finer route.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import release, schema_of, unused

#: Tables that are read once or twice and then deleted: cheap to write rather than small.
durable = partial(common.durable, codec="lz4_raw")

_PLACES = np.uint64((1 << 30) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _spread(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= _ODD[3]
    x ^= x >> np.uint64(32)
    return x


def gram_of(length: int) -> int:
    """Bytes of the anchor gram for windows of ``length``: about half, so that anchors stay sparse and rarely agree by chance."""
    if length < 128:
        raise ValueError("length must be at least 128")
    return 192 if length >= 384 else 96 if length >= 256 else 64


def ladder(data: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """By size (8 and its doubles up to ``top``) the hash of so many bytes from each place; zeros follow the data."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * top + 8, np.uint8)])
    eight = np.zeros(n + 2 * top, dtype="<u8")
    for i in range(8):
        part = padded[i : i + (len(eight) - i + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view("<u8")
        eight[i::8][: len(part)] = part[: len(eight[i::8])]
    now, size = _spread(eight * _ODD[0]), 8
    levels = {8: now}
    while size * 2 <= top:
        now = _spread(now[:-size] * _ODD[(1, 2, 4, 5)[size.bit_length() % 4]] + now[size:])
        size *= 2
        levels[size] = now
    return levels


def gram_hashes(levels: dict[int, np.ndarray], n: int, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (two or three times a power of two) from each of ``n`` places."""
    if gram in levels:
        return levels[gram][:n]
    half = gram // 3
    return _spread(levels[half][:n] * _ODD[1] + levels[2 * half][half : half + n])


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor's distance from the first, gram, segment) of every run of windows with one anchor, as columns.

    ``segment`` is a hash of the bytes of all windows of the run and of the distance.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    levels = ladder(data, 128)
    ends = np.repeat(np.cumsum(sizes), sizes)
    gram = gram_of(length)
    grams = gram_hashes(levels, n, gram)
    least = (grams & ~_PLACES) | np.arange(n, dtype=np.uint64)
    width, step = length - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if rest := width - step:
        least = np.minimum(least[:-rest], least[rest:])
    at = np.flatnonzero(ends - np.arange(n) >= length)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    anchor = (least[at] & _PLACES).astype(np.int64)
    cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
    first = np.concatenate([[0], cuts])
    count = np.diff(np.concatenate([first, [len(at)]]))
    begin, anchor = at[first], anchor[first]
    ahead, size = anchor - begin, count - 1 + length
    segment = _spread(ahead.astype(np.uint64) * _ODD[1] + size.astype(np.uint64))
    for k in range(int(-(-size.max() // 128))):  # overlapping parts that cover the segment
        more = np.flatnonzero(size > 128 * k)
        segment[more] = _spread(segment[more] * _ODD[5] + levels[128][begin[more] + np.minimum(128 * k, size[more] - 128)])
    starts = np.cumsum(sizes) - sizes
    of = np.searchsorted(starts + sizes, begin, side="right")
    return of, begin - starts[of], count, ahead, grams[anchor].view(np.int64), segment.view(np.int64)


def suffix_arrays(texts: list[bytes], bucket: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix arrays of several buckets of texts, in lock step.

    ``bucket`` numbers the bucket of each text, ascending from 0. Returns the order of all suffixes, bucket after bucket
    (places in the joined texts with one end mark, smaller than any byte, before the first and after every text), and
    the bucket of each place. Ends of texts compare by the order of the texts.
    """
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    joined = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
    n = len(joined)
    marks = np.concatenate([[0], np.cumsum(lens + 1)])
    chars = joined.astype(np.int64) + 1
    chars[marks] = 0
    bucket = np.asarray(bucket, dtype=np.int64)
    of = np.concatenate([[-1], np.repeat(bucket, lens + 1)])
    key = of * 257 + chars
    order = np.argsort(key, kind="stable")
    slot = np.empty(n, np.int64)
    slot[order] = np.arange(n)
    sorted_key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(sorted_key) != 0]))
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.concatenate([heads, [n]]))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, size[heads])
    is_mark = chars == 0
    lyndon = np.ones(n, np.int64)
    left = np.arange(n)  # a place itself while its group waits; later what to look at on its left
    flag = np.zeros(n, bool)
    buckets = np.unique(of[of >= 0])
    low_end = np.searchsorted(of[order], buckets, side="left") + np.bincount(bucket, minlength=len(buckets))[buckets]
    high = np.searchsorted(of[order], buckets, side="right")
    floor = low_end
    while True:
        live = high > floor
        if not live.all():
            high, floor = high[live], floor[live]
        if not len(high):
            break
        # The highest waiting group of each bucket.
        begin = group[order[high - 1]]
        count = high - begin
        members = order[np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        left[members] = members - 1
        smaller = members - 1
        while True:
            further = left[smaller]
            if (further == smaller).all():
                break
            smaller = left[further]
        left[members] = smaller
        high = begin
        keep = ~is_mark[smaller]
        parents, at, times = np.unique(smaller[keep], return_index=True, return_counts=True)
        if not len(parents):
            continue
        grown = lyndon[members[keep][at]] * times
        # Split the parents off their groups, those with more members pointing at them higher.
        their = group[parents]
        by = np.lexsort((times, their))
        parents, their, times, grown = parents[by], their[by], times[by], grown[by]
        first = np.flatnonzero(np.concatenate([[True], np.diff(their) != 0]))
        moved = np.diff(np.concatenate([first, [len(their)]]))
        tail = np.repeat(their[first] + size[their[first]] - moved, moved)
        target = tail + np.arange(len(parents)) - np.repeat(first, moved)
        flag[parents] = True
        sitting = order[target]
        displaced = sitting[~flag[sitting]]
        flag[parents] = False
        old = slot[parents]
        vacated = old[old < tail]
        order[vacated] = displaced
        slot[displaced] = vacated
        order[target] = parents
        slot[parents] = target
        size[their[first]] -= moved
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(their) != 0) | (np.diff(times) != 0)]))
        counts = np.diff(np.concatenate([fresh, [len(their)]]))
        size[target[fresh]] = counts
        group[parents] = np.repeat(target[fresh], counts)
        lyndon[parents] += grown
    # Emit: in ascending order each suffix places those whose next smaller suffix it is, at the front of their groups.
    after = np.arange(n) + lyndon
    after[is_mark] = n
    by_after = np.argsort(after, kind="stable")
    first_child = np.searchsorted(after[by_after], np.arange(n + 1))
    free = np.arange(n)
    begin, end = np.searchsorted(of[order], buckets, side="left"), np.searchsorted(of[order], buckets, side="right")
    out = np.full(n, -1, np.int64)
    out[0] = order[0]
    own_marks = marks[1:]
    out[np.repeat(begin - np.concatenate([[0], np.cumsum(low_end - begin)[:-1]]), low_end - begin) + np.arange(len(own_marks))] = own_marks
    free[begin] = low_end
    step = begin.copy()
    while len(step):
        # All places of a group that are filled so far are final; they emit together, in order.
        ready = np.minimum(free[group[out[step]]], end) - step
        here = out[np.repeat(step - (np.cumsum(ready) - ready), ready) + np.arange(ready.sum())]
        a, width = first_child[here], first_child[here + 1] - first_child[here]
        total = int(width.sum())
        if total:
            children = by_after[np.repeat(a - (np.cumsum(width) - width), width) + np.arange(total)]
            to = group[children]
            by = np.argsort(to, kind="stable")
            children, to = children[by], to[by]
            head = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            many = np.diff(np.concatenate([head, [total]]))
            out[np.repeat(free[to[head]] - head, many) + np.arange(total)] = children
            free[to[head]] += many
        step = step + ready
        live = step < end
        if not live.all():
            step, end = step[live], end[live]
    return out[1:], of


def repeated(segments: list[bytes], windows: list[int], weights: list[int], bucket: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its first ``windows`` windows occur more than once in its bucket (by ``weights``).

    Neighbours in the suffix array are equal windows if the 64-bit hashes of their first and last bytes are.
    """
    order, _ = suffix_arrays(segments, bucket)
    lens = np.array([len(t) for t in segments], dtype=np.int64)
    starts = np.cumsum(lens + 1) - lens
    count = np.array(windows, dtype=np.int64)
    of = np.full(lens.sum() + len(lens) + 1, -1, np.int64)
    base = np.cumsum(count) - count
    places = np.repeat(starts - base, count) + np.arange(count.sum())
    of[places] = np.repeat(np.arange(len(lens)), count)
    number = np.zeros(len(of), np.int64)
    number[places] = np.arange(len(places))
    order = order[of[order] >= 0]
    data = np.frombuffer(b"\0" + b"\0".join(segments) + b"\0", np.uint8)
    part = 1 << (length.bit_length() - 1)
    prints = ladder(data, part)[part]
    a, b = order[:-1], order[1:]
    same = np.asarray(bucket)[of[a]] == np.asarray(bucket)[of[b]] if len(order) else np.zeros(0, bool)
    left = np.flatnonzero(same)
    for at in (0, length - part):  # the two parts overlap and make up the window
        left = left[prints[a[left] + at] == prints[b[left] + at]]
    alike = np.zeros(max(len(order) - 1, 0), bool)
    alike[left] = True
    cls = np.concatenate([[0], np.cumsum(~alike)]) if len(order) else np.zeros(0, np.int64)
    total = np.bincount(cls, np.array(weights)[of[order]]) if len(order) else np.zeros(0)
    hit = np.zeros(len(places), bool)
    hit[number[order]] = total[cls] > 1
    return np.split(hit, np.cumsum(count)[:-1]) if len(count) else []


def spans(hits: np.ndarray) -> list[tuple[int, int]]:
    """(start, number) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hits.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def merged(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal covered byte spans of runs (first window, number of windows)."""
    out: list[list[int]] = []
    for a, n in sorted(windows):
        b = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    return b"".join(kept) + text[at:]


def print_of(data: bytes, windows: int) -> int:
    return xxhash.xxh3_64_intdigest(data, windows) - (1 << 63)


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    """(key, size, firsts, windows, ahead, gram, segment): the runs of each text; segment is the hash of its bytes.

    Runs of one text with equal bytes (a text that repeats itself has very many) are one row with all their starts.
    """

    def run(batches):
        for batch in batches:
            keys, sizes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.binary())
            at = 0
            while at < len(keys):
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:], dtype=np.int64), 1 << 17, side="right")))
                some = texts.slice(at, to - at).to_pylist()
                of, first, windows, ahead, gram, segment = runs(some, length)
                by = np.lexsort((first, segment, gram, of))
                of, first, windows, ahead, gram, segment = (x[by] for x in (of, first, windows, ahead, gram, segment))
                head = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(gram) != 0) | (np.diff(segment) != 0)])) if len(of) else of
                firsts = pa.ListArray.from_arrays(pa.array(np.concatenate([head, [len(of)]]).astype(np.int32)), pa.array(first.astype(np.int32)))
                name = of[head] + at
                columns = [pa.array(keys[name]), pa.array(sizes[name]), firsts, *(pa.array(x[head].astype(np.int32)) for x in (windows, ahead)), pa.array(gram[head]), pa.array(segment[head])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "size", "firsts", "windows", "ahead", "gram", "segment"])
                at = to

    shape = "key long, size int, firsts array<int>, windows int, ahead int, gram long, segment long"
    return texts.where(F.col("size") >= length).select("key", "size", "text").mapInArrow(run, shape)


def _segments(texts: DataFrame, wanted: DataFrame, length: int, many: int, band: int) -> DataFrame:
    """(route, print, gram, segment, weight, shift, windows, bytes): the bytes of each wanted segment, once or more often."""

    def run(batches):
        names = ["route", "print", "gram", "segment", "weight", "shift", "windows", "bytes"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            rows, held = [], 0
            for text, parts in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for p in parts:
                    s, n, d = p["first"], p["windows"], p["ahead"]
                    if p["different"] <= many:
                        data = text[s : s + n - 1 + length]
                        rows.append((p["gram"], print_of(data, n), p["gram"], p["segment"], p["weight"], 0, n, data))
                        continue
                    anchor = s + d
                    for low in range((d - n + 1) // band * band, d + 1, band):
                        # Windows that start low .. low + band - 1 bytes before the anchor share what lies between.
                        a, b = max(s, anchor - low - band + 1), min(s + n - 1, anchor - low)
                        core = text[anchor - low : anchor - low - band + 1 + length]
                        route = xxhash.xxh3_64_intdigest(core, low) - (1 << 63)
                        data = text[a : b + length]
                        rows.append((route, print_of(data, b - a + 1), p["gram"], p["segment"], p["weight"], a - s, b - a + 1, data))
                held += 1
                if len(rows) > 20000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    once = texts.groupBy("key", "size").agg(F.first("text").alias("text"))
    return once.join(wanted, ["key", "size"]).select("text", "parts").mapInArrow(run, "route long, print long, gram long, segment long, weight long, shift int, windows int, bytes binary")


def _sorted_out(segments: DataFrame, length: int, batch_bytes: int = 1 << 20, held_bytes: int = 1 << 23) -> DataFrame:
    """(route, print, first, windows): runs of repeated windows, from one suffix array per route.

    ``segments`` has (route, print, weight, windows, bytes), every different text of a route once. Arrays of like sizes
    are built together, as those in lock step take as long as the largest.
    """

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        numbers = {r: i for i, r in enumerate(dict.fromkeys(x[0] for x in rows))}
        hits = repeated([x[4] for x in rows], [x[3] for x in rows], [x[2] for x in rows], [numbers[x[0]] for x in rows], length)
        out = [(x[0], x[1], a, n) for x, hit in zip(rows, hits) for a, n in spans(hit)]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else ((),) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["route", "print", "first", "windows"])

    def packed(routes: list[list[tuple]]):
        rows, held = [], 0
        size = {id(r): sum(len(x[4]) for x in r) for r in routes}
        for route in sorted((r for r in routes if sum(x[2] for x in r) > 1), key=lambda r: size[id(r)]):
            rows += route
            held += size[id(route)]
            if held >= batch_bytes:
                yield solve(rows)
                rows, held = [], 0
        if rows:
            yield solve(rows)

    def run(batches):
        routes, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not routes or row[0] != routes[-1][0][0]:
                    if held >= held_bytes:
                        yield from packed(routes)
                        routes, held = [], 0
                    routes.append([])
                routes[-1].append(row)
                held += len(row[-1])
        yield from packed(routes)

    return segments.select("route", "print", "weight", "windows", "bytes").repartition("route").sortWithinPartitions("route").mapInArrow(run, "route long, print long, first int, windows int")


def _meeting(pieces: DataFrame) -> DataFrame:
    """Those of ``pieces`` whose gram occurs twice, and whether all segments of the gram are equal."""
    grams = pieces.groupBy("gram").agg(F.sum(F.size("firsts")).alias("n"), (F.min("segment") == F.max("segment")).alias("equal")).where("n > 1")
    # Written first, so that both sides of the join are plain exchanges and a hot gram's pieces can be split.
    grams = durable(grams.select("gram", "equal"))
    found = durable(pieces.join(grams, "gram"))
    release(pieces, grams)
    return found


def repeated_windows(texts: DataFrame, length: int = 400, covered: DataFrame | None = None, many: int = 64, band: int = 16) -> DataFrame:
    """(key, size, runs) for the texts (key long, size int, text; every row counts) that hold repeated windows.

    With ``covered`` (key, size, spans of bytes a to b), runs of windows that lie in such spans take no part.
    """
    if length < gram_of(length) + band:
        raise ValueError(f"length must be at least {gram_of(length) + band}")
    shared = _meeting(durable(_pieces(texts, length)))
    if covered is not None:
        outside = F.exists("firsts", lambda f: ~F.exists(F.coalesce("spans", F.array()), lambda x: (x["a"] <= f) & (f + F.col("windows") - 1 + length <= x["b"])))
        uncovered = durable(shared.join(covered, ["key", "size"], "left").where(outside).drop("equal", "spans"))
        release(shared)
        shared = _meeting(uncovered)
    differing = durable(shared.where("NOT equal").groupBy("gram", "segment").agg(F.sum(F.size("firsts")).alias("weight"), F.min(F.struct("key", "size", F.col("firsts")[0].alias("first"), "windows", "ahead")).alias("at")))
    kinds = durable(differing.groupBy("gram").agg(F.count("*").alias("different")))
    part = F.struct("at.first", "at.windows", "at.ahead", "gram", "segment", "weight", "different")
    placed = durable(differing.join(kinds, "gram").select("at.key", "at.size", part.alias("part")))
    wanted = placed.groupBy("key", "size").agg(F.collect_list("part").alias("parts"))
    segments = durable(_segments(texts, wanted, length, many, band))
    # Equal bytes of a route enter the array once, with their number; their owners stay outside and are met by a join.
    once = segments.groupBy("route", "print").agg(F.sum("weight").alias("weight"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes"))
    found = durable(_sorted_out(once, length))
    by_print = durable(found.groupBy("route", "print").agg(F.collect_list(F.struct("first", "windows")).alias("hits")))
    hits = F.transform("hits", lambda x: F.struct((F.col("shift") + x["first"]).alias("first"), x["windows"].alias("windows")))
    owned = segments.select("route", "print", "gram", "segment", "shift").join(by_print, ["route", "print"]).select("gram", "segment", hits.alias("hits"))
    # The runs of a segment join as one list, so that a piece stays one row however many there are.
    lists = durable(owned.groupBy("gram", "segment").agg(F.flatten(F.collect_list("hits")).alias("hits")))
    release(differing, kinds, placed, segments, found, by_print)
    whole = shared.where("equal").select("key", "size", F.transform("firsts", lambda f: F.struct(f.alias("first"), F.col("windows"))).alias("runs"))
    back = shared.where("NOT equal").select("key", "size", "firsts", "gram", "segment").distinct().join(lists, ["gram", "segment"])  # copies of a text once
    moved = F.flatten(F.transform("firsts", lambda f: F.transform("hits", lambda x: F.struct((f + x["first"]).alias("first"), x["windows"].alias("windows")))))
    every = whole.union(back.select("key", "size", moved.alias("runs")))
    result = durable(every.groupBy("key", "size").agg(F.flatten(F.collect_set("runs")).alias("runs")))
    release(shared, lists)
    return result


SPANS = "array<struct<a:int,b:int>>"


def repeated_spans(texts: DataFrame, length: int, covered: DataFrame | None = None) -> DataFrame:
    """(key, size, spans) for the texts that hold repeated windows: the maximal spans of their bytes a to b."""
    found = repeated_windows(texts, length, covered)

    def run(batches):
        for batch in batches:
            runs = batch.column(2)
            cuts, flat = runs.offsets.to_numpy(), runs.flatten()
            firsts, many = (flat.field(i).to_numpy() for i in (0, 1))
            out = [[{"a": a, "b": b} for a, b in merged(list(zip(firsts[i:j].tolist(), many[i:j].tolist())), length)] for i, j in zip((cuts - cuts[0])[:-1], (cuts - cuts[0])[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["key", "size", "spans"])

    result = durable(found.mapInArrow(run, f"key long, size int, spans {SPANS}"))
    release(found)
    return result


def with_repeats_cut(docs: DataFrame, length: int = 400, as_text: bool = False, passage: int | None = None) -> DataFrame:
    """``docs`` with four more columns: n_bytes, n_removed, n_spans and kept (the remaining bytes).

    With ``as_text`` kept is a string instead; bytes of characters that a cut went through are left out. With
    ``passage``, a smaller number of bytes, a column ``without_passages`` follows: what is left when, besides, the
    strings of that length go that repeat outside of what ``length`` removes.

    Texts are UTF-8 bytes, null is empty. Repeated rows are documents of their own, so each is the other's repeat.
    Texts shorter than ``length`` keep everything. The new columns take the place of columns of these names. A text is
    read whole by one task and must be shorter than 2^30 bytes.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "without_passages")
    key, size, gaps = (unused(docs, x) for x in ("_key", "_size", "_spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({key: F.xxhash64(text), size: F.octet_length(text)})
    texts = keyed.select(F.col(key).alias("key"), F.col(size).alias("size"), text.alias("text"))
    found = repeated_spans(texts, length)
    if passage:
        short = repeated_spans(texts, passage, found)
        both = found.select("key", "size", F.lit(0).alias("level"), "spans").union(short.select("key", "size", F.lit(1).alias("level"), "spans"))
        lists = [F.flatten(F.collect_list(F.when(F.col("level") == level, F.col("spans")))).alias(f"s{level}") for level in (0, 1)]
        found = durable(both.groupBy("key", "size").agg(*lists).select("key", "size", F.array("s0", "s1").alias("spans")))
    else:
        found = found.select("key", "size", F.array("spans").alias("spans"))
    found = found.toDF(key, size, gaps)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            both = [[[(x["a"], x["b"]) for x in s] for s in g] if g else [[], []] for g in batch.column(batch.schema.get_field_index(gaps)).to_pylist()]
            kept = [cut(t, g[0]) for t, g in zip(texts, both)]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            more = [pa.array(sizes), pa.array(sizes - np.array([len(k) for k in kept], dtype=np.int64)), pa.array([len(g[0]) for g in both], pa.int64()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
            if passage:
                less = [cut(t, merged([(a, b - a) for a, b in g[0] + g[1]], 1)) if g[1] else k for t, g, k in zip(texts, both, kept)]
                more.append(pa.array([k.decode("utf-8", "ignore") for k in less], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *more], [*names, "n_bytes", "n_removed", "n_spans", "kept", *["without_passages"] * bool(passage)])

    shape = schema_of(docs) + f", n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}" + ", without_passages string" * bool(passage)
    return keyed.join(found.hint("merge"), [key, size], "left").select(*(f"`{n}`" for n in names), gaps).mapInArrow(run, shape)


#: Bytes of fifty words and more: passages of more words than that are caught whole.
PASSAGE = 256


def op2_suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) of every document, for strings of 400 bytes.

    ``text`` is what is left without passages of over fifty words that repeat, too: strings of 256 bytes that occur
    again outside of what the 400-byte strings remove.
    """
    cut_docs = with_repeats_cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), passage=PASSAGE)
    return cut_docs.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("without_passages").alias("text"))
