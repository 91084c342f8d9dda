"""Lagged features that end before the step they predict, and expanding splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(by: list[str], pos: str) -> Window:
    return Window.partitionBy(*by).orderBy(pos)


def full_window(x: Column, how, w: Window, first: int, last: int) -> Column:
    """An aggregate over rows ``first``..``last`` from here, null unless all of them have values."""
    frame = w.rowsBetween(first, last)
    return F.when(F.count(x).over(frame) == last - first + 1, how(x).over(frame))


def level_features(df: DataFrame, by: list[str], pos: str, value: str, lags: tuple[int, ...] = (1, 2, 3, 6, 12)) -> DataFrame:
    """Lags, changes, means and spread of the level, all ending one step back. Needs a complete calendar."""
    w, x = order(by, pos), F.col(value)
    lag = lambda k: F.lag(x, k).over(w)
    features = {f"level_lag{k}": lag(k) for k in lags}
    features |= {"level_diff1": lag(1) - lag(2), "level_diff3": lag(1) - lag(4), "level_mean3": full_window(x, F.avg, w, -3, -1), "level_mean6": full_window(x, F.avg, w, -6, -1), "level_std3": full_window(x, F.stddev_samp, w, -3, -1)}
    return df.withColumns(features)


def driver_features(df: DataFrame, by: list[str], pos: str, lags: Mapping[str, int], windows: tuple[int, ...] = (3, 6)) -> DataFrame:
    """For each driver its value ``lag`` steps back, and its means over windows that end there."""
    w, features = order(by, pos), {}
    for name, lag in lags.items():
        x = F.col(name)
        features[f"{name}_at"] = F.lag(x, lag).over(w) if lag >= 0 else F.lead(x, -lag).over(w)
        for n in windows:
            features[f"{name}_mean{n}"] = full_window(x, F.avg, w, -lag - n + 1, -lag)
    return df.withColumns(features)


def expanding_splits(counts: DataFrame, n: str = "n", folds: int = 3, least: float = 0.5, smallest: int = 5) -> DataFrame:
    """(…, fold, train_end, val_end) for each row of ``counts``; none where folds would be smaller than ``smallest``."""
    rows = counts.withColumn("_start", F.floor(F.col(n) * least)).withColumn("_size", F.floor((F.col(n) - F.col("_start")) / (folds + 1)))
    rows = rows.where(F.col("_size") >= smallest).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = rows.withColumn("train_end", F.col("_start") + F.col("fold") * F.col("_size")).withColumn("val_end", F.col("train_end") + F.col("_size"))
    return rows.where(F.col("val_end") <= F.col(n)).drop("_start", "_size")
