"""Calendars: complete positions per entity, unions of panels, the train and test parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def densify(df: DataFrame, by: list[str], time: str, step: str | None = None) -> DataFrame:
    """Every step between an entity's first and last time; missing steps get nulls. ``step``: an interval such as
    '1 month' for dates, None for whole numbers. Nothing may be dropped before lags are taken, so this comes first."""
    ends = df.where(F.col(time).isNotNull()).groupBy(*by).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    series = F.sequence("_a", "_b", F.expr(f"interval {step}")) if step else F.sequence("_a", "_b")
    kind = df.schema[time].dataType
    return ends.select(*by, F.explode(series).alias(time)).withColumn(time, F.col(time).cast(kind)).join(df, [*by, time], "left")


def positions(df: DataFrame, by: list[str], time: str, name: str = "pos") -> DataFrame:
    """0-based position on an entity's (complete) calendar."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1).cast("long"))


def train_flag(df: DataFrame, by: list[str], horizon: int, pos: str = "pos", name: str = "is_train") -> DataFrame:
    """True for all but the last ``horizon`` positions of the entity's own panel."""
    return df.withColumn(name, F.col(pos) < F.count("*").over(Window.partitionBy(*by)) - horizon)


def assemble(levels: DataFrame, drivers: list[DataFrame], by: list[str], time: str, step: str | None = None) -> DataFrame:
    """The levels' calendar, completed; each frame of drivers joins on it from the left."""
    out = densify(levels, by, time, step)
    for frame in drivers:
        out = out.join(frame, [*by, time], "left")
    return out


def union_panel(a: DataFrame, b: DataFrame, time: str, step: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Two series (by, time, value) on the union of their calendars: value_a, value_b."""
    by = by or []
    left, right = a.select(*by, time, F.col("value").alias("value_a")), b.select(*by, time, F.col("value").alias("value_b"))
    return densify(left.join(right, [*by, time], "full"), by, time, step)


def coverage(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Share of an entity's stations that report at each time."""
    return df.groupBy(*by, time).agg((F.count(value) / F.count("*")).alias("coverage"))


def strict_sum(value: str | Column) -> Column:
    """Sum that is null as soon as one part is."""
    x = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def yearly_completeness(df: DataFrame, by: list[str], time: str, value: str, full: str, first: int, last: int, exempt_last: bool = False) -> DataFrame:
    """Per entity: months present (value and a full month) as a share of the years' months, and whether a year is wholly
    missing. With ``exempt_last`` the last year is left out of the check, and of the share too where it is empty."""
    spans = df.select(*by).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    present = F.count(F.when(F.col(value).isNotNull() & F.col(full), 1))
    years = spans.join(df.withColumn("year", F.year(time)).groupBy(*by, "year").agg(present.alias("months")), [*by, "year"], "left").withColumn("months", F.coalesce("months", F.lit(0)))
    final = (F.col("year") == last) & F.lit(exempt_last)
    counted = ~(final & (F.col("months") == 0))
    return years.groupBy(*by).agg(
        F.sum("months").cast("long").alias("months_present"),
        (100.0 * F.sum("months") / (12 * F.sum(F.when(counted, 1).otherwise(0)))).alias("completeness"),
        F.coalesce(F.bool_or((F.col("months") == 0) & ~final), F.lit(False)).alias("has_missing_year"),
    )
