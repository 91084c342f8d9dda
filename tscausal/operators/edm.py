"""Empirical dynamic modelling as relations: delay embeddings, cross mapping and simplex projection.

Numerics: E + 1 nearest neighbours by Euclidean distance, a point is not its own neighbour, ties by time; weights
exp(-d / least d), at least 1e-6; with a least distance of 0 exact matches weigh 1 and the rest 1e-6. The neighbours of
a point join within their series only. ``crossmap`` has the same numbers for long series and many surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import correlation


def embed(df: DataFrame, by: list[str], pos: str, effect: str, cause: str, lags: list[int], size: int, tau: int = 1) -> DataFrame:
    """(by, lag, pos, y, v1..vE): y is the cause at pos, v the effect at pos + lag, pos + lag - tau, …

    Shifts happen on the complete calendar, rows with nulls go afterwards.
    """
    w = Window.partitionBy(*by).orderBy(pos)
    shifted = lambda d: F.lead(effect, d).over(w) if d >= 0 else F.lag(effect, -d).over(w)
    offsets = sorted({lag - k * tau for lag in lags for k in range(size)})
    wide = df.select(*by, pos, F.col(cause).alias("y"), *(shifted(d).alias(f"_o{d - offsets[0]}") for d in offsets))
    points = F.array(*(F.struct(F.lit(lag).alias("lag"), *(F.col(f"_o{lag - k * tau - offsets[0]}").alias(f"v{k + 1}") for k in range(size))) for lag in lags))
    out = wide.select(*by, pos, "y", F.explode(points).alias("p")).select(*by, pos, "y", "p.*")
    return out.dropna(subset=["y", *(f"v{k + 1}" for k in range(size))])


def neighbours(points: DataFrame, keys: list[str], pos: str, size: int, apart: int = 0) -> DataFrame:
    """(keys, pos, y, d, near_y): the size + 1 nearest other points, more than ``apart`` steps away."""
    theirs = points.select(*keys, F.col(pos).alias("_q"), F.col("y").alias("near_y"), *(F.col(f"v{k + 1}").alias(f"u{k + 1}") for k in range(size)))
    square: Column = F.lit(0.0)
    for k in range(size):
        square = square + (F.col(f"v{k + 1}") - F.col(f"u{k + 1}")) * (F.col(f"v{k + 1}") - F.col(f"u{k + 1}"))
    pairs = points.join(theirs, keys).where(F.abs(F.col(pos) - F.col("_q")) > apart).withColumn("d", F.sqrt(square))
    rank = F.row_number().over(Window.partitionBy(*keys, pos).orderBy("d", "_q"))
    return pairs.withColumn("_k", rank).where(F.col("_k") <= size + 1).select(*keys, pos, "y", "d", "near_y")


def projected(near: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """(keys, pos, y, predicted): weighted means over the neighbours."""
    least = F.min("d").over(Window.partitionBy(*keys, pos))
    weight = F.when(least == 0, F.when(F.col("d") == 0, 1.0).otherwise(1e-6)).otherwise(F.greatest(F.exp(-F.try_divide("d", F.nullif(least, F.lit(0.0)))), F.lit(1e-6)))
    rows = near.withColumn("_w", weight)
    return rows.groupBy(*keys, pos).agg(F.first("y").alias("y"), (F.sum(F.col("_w") * F.col("near_y")) / F.sum("_w")).alias("predicted"))


def cross_map(df: DataFrame, by: list[str], pos: str, cause: str, effect: str, lags: list[int], size: int, tau: int = 1, least: int | None = None) -> DataFrame:
    """(by, lag, n, rho): skill of estimating ``cause`` from the history of ``effect``, one row per lag.

    ``least``: smallest number of points, max(20, E + 5) if not given; 0 keeps every lag (the scan without a test).
    """
    least = max(20, size + 5) if least is None else least
    keys = [*by, "lag"]
    points = embed(df, by, pos, effect, cause, lags, size, tau)
    skill = projected(neighbours(points, keys, pos, size), keys, pos).groupBy(*keys).agg(F.count("*").alias("n"), correlation("y", "predicted").alias("rho"))
    return skill.where(F.col("n") >= least)


def best_lag(profile: DataFrame, by: list[str], first: int | None = None) -> DataFrame:
    """(by, lag, n, rho) of the largest skill, the smallest lag on ties; ``first``: least lag that may be chosen."""
    rows = profile.where(F.col("rho").isNotNull())
    if first is not None:
        rows = rows.where(F.col("lag") >= first)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rho"), "lag"))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def simplex_skill(df: DataFrame, by: list[str], pos: str, value: str, sizes: list[int], tau: int = 1, ahead: int = 1) -> DataFrame:
    """(by, size, rho): skill of predicting a series from its own past, for each embedding dimension."""
    w = Window.partitionBy(*by).orderBy(pos)
    out = None
    for size in sizes:
        vector = {f"v{k + 1}": (F.lag(value, k * tau).over(w) if k else F.col(value)) for k in range(size)}
        points = df.select(*by, pos, F.lead(value, ahead).over(w).alias("y"), *(c.alias(n) for n, c in vector.items())).dropna().withColumn("size", F.lit(size))
        keys = [*by, "size"]
        skill = projected(neighbours(points, keys, pos, size, max(tau, 1)), keys, pos).groupBy(*keys).agg(F.count("*").alias("n"), correlation("y", "predicted").alias("rho")).where("n >= 2").drop("n")
        out = skill if out is None else out.union(skill)
    return out


def choose_size(skill: DataFrame, by: list[str]) -> DataFrame:
    """(by, size): the dimension of the largest skill, the first on ties, 2 where none has a skill."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("rho"), "size"))
    best = skill.withColumn("_k", rank).where("_k = 1")
    return best.select(*by, F.when(F.col("rho").isNull(), 2).otherwise(F.col("size")).alias("size"))


def convergence(points: DataFrame, keys: list[str], pos: str, size: int, libraries: list[int], samples: int = 5) -> DataFrame:
    """(keys, library, n, rho): mean skill when neighbours come from random libraries of a given size.

    A library is the points of least md5(sample, pos), so it is random but the same everywhere; ``points`` as in ``embed``.
    """
    each = points.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    rank = F.row_number().over(Window.partitionBy(*keys, "sample").orderBy(F.md5(F.concat_ws("|", "sample", F.col(pos).cast("string"))), pos))
    theirs = each.withColumn("_r", rank).select(*keys, "sample", F.col(pos).alias("_q"), F.col("y").alias("near_y"), "_r", *(F.col(f"v{k + 1}").alias(f"u{k + 1}") for k in range(size)))
    theirs = theirs.withColumn("library", F.explode(F.array(*map(F.lit, libraries)))).where(F.col("_r") <= F.col("library")).drop("_r")
    square: F.Column = F.lit(0.0)
    for k in range(size):
        square = square + (F.col(f"v{k + 1}") - F.col(f"u{k + 1}")) * (F.col(f"v{k + 1}") - F.col(f"u{k + 1}"))
    groups = [*keys, "library", "sample"]
    pairs = each.join(theirs, [*keys, "sample"]).where(F.col(pos) != F.col("_q")).withColumn("d", F.sqrt(square))
    order = F.row_number().over(Window.partitionBy(*groups, pos).orderBy("d", "_q"))
    near = pairs.withColumn("_k", order).where(F.col("_k") <= size + 1).select(*groups, pos, "y", "d", "near_y")
    skill = projected(near, groups, pos).groupBy(*groups).agg(correlation("y", "predicted").alias("rho"))
    return skill.groupBy(*keys, "library").agg(F.count("rho").alias("n"), F.avg("rho").alias("rho"))


def shifted_nulls(df: DataFrame, by: list[str], pos: str, x: str, y: str, shifts: list[int]) -> DataFrame:
    """(by, shift, rho): correlation with y moved around the calendar by each shift; shift 0 is the observed one."""
    n = F.count("*").over(Window.partitionBy(*by))
    left = df.select(*by, F.col(pos).alias("_p"), F.col(x).alias("_x"), n.alias("_n")).withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    left = left.withColumn("_at", F.pmod(F.col("_p") + F.col("shift"), F.col("_n")))
    right = df.select(*by, F.col(pos).alias("_at"), F.col(y).alias("_y"))
    return left.join(right, [*by, "_at"]).groupBy(*by, "shift").agg(correlation("_x", "_y").alias("rho"))
