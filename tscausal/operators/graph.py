"""Directed graphs of causal edges as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import durable


def last_edges(edges: DataFrame, by: list[str], order: str) -> DataFrame:
    """One edge per (by, cause, effect), the last in order."""
    keys = [*by, "cause", "effect"]
    rest = [c for c in edges.columns if c not in keys]
    return edges.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def ancestors(edges: DataFrame, by: list[str], target: str, steps: int = 1000) -> DataFrame:
    """(by, variable): everything with a path into ``target``, however long, but not itself. Cycles are fine: a step
    keeps what was not reached before only, until none is left."""
    arcs = durable(edges.select(*by, "cause", "effect").distinct())
    found = front = durable(arcs.where(F.col("effect") == target).select(*by, F.col("cause").alias("variable")).distinct())
    for _ in range(steps):
        step = arcs.join(front.withColumnRenamed("variable", "effect"), [*by, "effect"]).select(*by, F.col("cause").alias("variable")).distinct()
        front = durable(step.join(found, [*by, "variable"], "left_anti"))
        if front.isEmpty():
            return found.where(F.col("variable") != target)
        found = durable(found.union(front))
    raise RuntimeError(f"a path is longer than {steps} steps")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node of each undirected component, by rounds of neighbours' and labels' minima."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct()
    both = durable(both)
    labels = durable(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        new = labels.join(near, "node").select("node", F.least("component", "c").alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = durable(new.join(jump, "component").select("node", F.col("further").alias("component")))
        changed = new.exceptAll(labels).limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def upstream(areas: DataFrame, outlet: DataFrame, node: str = "node", down: str = "next_down", steps: int = 1000) -> DataFrame:
    """(node) of all areas that drain into ``outlet`` (node), itself included."""
    found = front = durable(outlet.select(node).distinct())
    for _ in range(steps):
        front = durable(areas.join(front.withColumnRenamed(node, down), down).select(node).join(found, node, "left_anti").distinct())
        if front.isEmpty():
            return found
        found = durable(found.union(front))
    raise RuntimeError("the drainage does not end")


def tiers(pairs: DataFrame, direct: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds tier to (a, b) pairs: 1 directly joined, 2 same component, 3 same system, 4 different.

    ``direct`` holds undirected (a, b) pairs, ``groups`` (node, component, system); nodes without component have a null.
    """
    key = lambda: F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"))
    joined = direct.select(key().alias("_key")).distinct().withColumn("_direct", F.lit(True))
    left, right = (groups.select(F.col("node").alias(n), F.col("component").alias(f"_c{n}"), F.col("system").alias(f"_s{n}")) for n in ("a", "b"))
    out = pairs.withColumn("_key", key()).join(joined, "_key", "left").join(left, "a", "left").join(right, "b", "left")
    tier = F.when(F.col("_direct"), 1).when(F.col("_ca") == F.col("_cb"), 2).when(F.col("_sa") == F.col("_sb"), 3).otherwise(4)
    return out.withColumn("tier", tier).select(*pairs.columns, "tier")
