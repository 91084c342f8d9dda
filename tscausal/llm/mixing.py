"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source_size times. The whole part is fixed; the fraction is a
probability that has to become 0 or 1. Pivotal rounding pairs two fractional documents and moves mass between them, in
words and at random so that expectations stay, until one is integral; the words of the pair together never change. The
documents of a (source, bucket) group are paired where they lie, which leaves at most one fractional document, and the
leftovers of 64 groups meet in a group of the next level: a reduction tree over fixed buckets, so a hot source is
spread over all buckets and no task sees more than a bounded number of rows. The one document left at a source's root
is taken in part, so a source misses its target by less than one word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable

SHAPE = "doc_id long, source string, size long, source_size long, target double, whole long, p double, bucket long, open boolean"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes by weight, no target above ``most`` times its source.

    Weights repeat over the sources by code point, null last. What a stopped source can't hold is shared again by
    weight. Sorted by size per weight the stopped sources are a prefix, so one pass of running sums finds the level
    at which the rest stand. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "place")
    everything = Window.partitionBy()
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("place", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") - 1) % len(weights) + 1))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everything) - before) / rest)
    found = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(everything)["level"]
    return rows.withColumn("level", found).select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def settle(p: np.ndarray, size: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds fractions ``p`` of ``size`` words in place of one another; returns them and the index still open, or -1."""
    out, held = p.tolist(), -1
    words, draws = size.tolist(), random.random(len(p)).tolist()
    for i, q in enumerate(out):
        if not 0 < q < 1:
            continue
        if held < 0:
            held = i
            continue
        p0, a, b = out[held], words[held], words[i]
        up, down = min(a * (1 - p0), b * q), min(a * p0, b * (1 - q))
        if draws[i] * (up + down) < down:
            full, empty = a * (1 - p0) <= b * q, b * q <= a * (1 - p0)
            out[held], out[i] = (1.0 if full else p0 + up / a), (0.0 if empty else q - up / b)
        else:
            empty, full = a * p0 <= b * (1 - q), b * (1 - q) <= a * p0
            out[held], out[i] = (0.0 if empty else p0 - down / a), (1.0 if full else q + down / b)
        held = held if 0 < out[held] < 1 else i if 0 < out[i] < 1 else -1
    return np.array(out), held


def round_level(rows: DataFrame, seed: int, level: int) -> DataFrame:
    def run(key, frame):
        name, bucket = (None if pd.isna(x) else x for x in key)
        frame = frame.assign(turn=[xxhash.xxh64_intdigest(f"{seed} {a} {b}") for a, b in zip(frame["doc_id"], frame["size"])])
        frame = frame.sort_values(["turn", "doc_id", "size", "p"], kind="stable").drop(columns="turn")
        random = np.random.default_rng([seed, level, int(bucket), xxhash.xxh32_intdigest(repr(name))])
        p, held = settle(frame["p"].to_numpy(), frame["size"].to_numpy(), random)
        return frame.assign(p=p, open=np.arange(len(p)) == held)

    return rows.groupBy("source", "bucket").applyInPandas(run, SHAPE)


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, bucket_rows: int = 4096, fan: int = 64) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    Size is the number of words (null text: 0). A source of size 0 has target 0. Null sources are one source, the last.
    Repeated rows are documents of their own; documents without words take nothing. The order of the draws follows
    from ids and sizes alone, so reruns agree whatever the partitioning.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    aims = targets(sized, weights, share, most)
    buckets = -(-sized.count() // bucket_rows) or 1
    copies = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    rows = sized.join(aims.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("p", F.when(F.col("size") > 0, copies - F.floor(copies)).otherwise(0.0))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets))).withColumn("open", F.lit(True))
    done, level = [], 0
    while True:
        rows = durable(round_level(rows.select(*(c.split()[0] for c in SHAPE.split(", "))), seed, level))
        done.append(rows.where(~F.col("open")))
        rows, level = rows.where("open"), level + 1
        if buckets == 1:
            break
        rows, buckets = rows.withColumn("bucket", F.floor(F.col("bucket") / fan)), -(-buckets // fan)
    done.append(rows)
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    taken = F.col("whole") * F.col("size") + F.round(F.col("p") * F.col("size")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def op4_mixing(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) with weights 5, 2, 1 and a share of 150 %."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
