"""Gaps as islands: runs of nulls between observed values, and the two kinds of filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], pos: str) -> Window:
    return Window.partitionBy(*by).orderBy(pos)


def null_runs(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """One row per run of nulls: run_start, run_end (positions) and run_length."""
    island = F.count(value).over(_over(by, pos).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_island", island).where(F.col(value).isNull()).groupBy(*by, "_island").agg(F.min(pos).alias("run_start"), F.max(pos).alias("run_end"), F.count("*").alias("run_length")).drop("_island")


def longest_gap(df: DataFrame, by: list[str], pos: str, value: str) -> DataFrame:
    """(by, longest): length of the longest run of nulls, 0 without any."""
    runs = null_runs(df, by, pos, value).groupBy(*by).agg(F.max("run_length").alias("longest"))
    return df.select(*by).distinct().join(runs, by, "left").select(*by, F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def without_long_gaps(df: DataFrame, by: list[str], pos: str, value: str, limit: int, train: str = "is_train") -> DataFrame:
    """Series whose training part has no run of more than ``limit`` nulls."""
    long = null_runs(df.where(train), by, pos, value).where(F.col("run_length") > limit).select(*by).distinct()
    return df.join(long, by, "left_anti")


def gap_share(df: DataFrame, by: list[str], value: str, limit: float, train: str = "is_train") -> DataFrame:
    """(by, missing, warned): share of nulls in the training part."""
    share = F.avg(F.col(value).isNull().cast("double"))
    return df.where(train).groupBy(*by).agg(share.alias("missing"), (share > limit).alias("warned"))


def gap_spans(df: DataFrame, by: list[str], pos: str, value: str, least: int = 2) -> DataFrame:
    """(by, span_start, span_end) of runs of at least ``least`` nulls; the end is the next observed position, or the last."""
    last = df.groupBy(*by).agg(F.max(pos).alias("_last"))
    runs = null_runs(df, by, pos, value).where(F.col("run_length") >= least).join(last, by)
    return runs.select(*by, F.col("run_start").alias("span_start"), F.least(F.col("run_end") + 1, F.col("_last")).alias("span_end"))


def bounded_fill(df: DataFrame, by: list[str], pos: str, value: str, limit: int, name: str | None = None) -> DataFrame:
    """Fills whole runs of at most ``limit`` nulls: linearly between observations, by the only one at an edge. Longer runs stay."""
    before = _over(by, pos).rowsBetween(Window.unboundedPreceding, 0)
    after = _over(by, pos).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(pos))
    df = df.withColumns({"_l": F.last(value, True).over(before), "_lp": F.last(at, True).over(before), "_r": F.first(value, True).over(after), "_rp": F.first(at, True).over(after)})
    ends = Window.partitionBy(*by)
    low, high = F.min(pos).over(ends), F.max(pos).over(ends)
    length = F.coalesce(F.col("_rp"), high + 1) - F.coalesce(F.col("_lp"), low - 1) - 1
    line = F.col("_l") + (F.col("_r") - F.col("_l")) * (F.col(pos) - F.col("_lp")) / (F.col("_rp") - F.col("_lp"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(length <= limit, F.coalesce(line, F.col("_l"), F.col("_r")))
    return df.withColumn(name or value, filled).drop("_l", "_lp", "_r", "_rp")


def limited_ffill(df: DataFrame, by: list[str], pos: str, value: str, limit: int, name: str | None = None) -> DataFrame:
    """Carries an observation over the first ``limit`` nulls of any run, long ones too."""
    return df.withColumn(name or value, F.last(value, True).over(_over(by, pos).rowsBetween(-limit, 0)))
