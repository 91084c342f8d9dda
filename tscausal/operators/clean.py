"""Station cleaning and combination, and deseasonalising."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def _median(x) -> F.Column:
    return F.percentile(x, F.lit(0.5))


def outliers(df: DataFrame, by: list[str], month: str, value: str, jump_z: float = 6.0, level_z: float = 5.0, least: int = 10) -> DataFrame:
    """(by, month) of confirmed outliers of each station.

    A jump between neighbouring observations whose robust z is above ``jump_z`` makes its month, and the calendar month
    before if observed, a candidate; a candidate is an outlier if the robust z of its level is above ``level_z``. A
    station needs ``least`` jumps and a positive median absolute deviation of jumps and levels.
    """
    seen = df.where(F.col(value).isNotNull()).select(*by, month, F.col(value).alias("_x"))
    seen = seen.withColumn("_d", F.col("_x") - F.lag("_x").over(Window.partitionBy(*by).orderBy(month)))
    centres = seen.groupBy(*by).agg(_median(F.col("_d")).alias("_dm"), _median(F.col("_x")).alias("_xm"), F.count("_d").alias("_n"))
    seen = seen.join(centres, by)
    spreads = seen.groupBy(*by).agg(_median(F.abs(F.col("_d") - F.col("_dm"))).alias("_ds"), _median(F.abs(F.col("_x") - F.col("_xm"))).alias("_xs"))
    seen = seen.join(spreads, by).where((F.col("_n") >= least) & (F.col("_ds") > 0) & (F.col("_xs") > 0))
    jumps = seen.where(F.abs(F.col("_d") - F.col("_dm")) / (MAD_SCALE * F.col("_ds")) > jump_z)
    flagged = jumps.select(*by, F.explode(F.array(F.col(month), F.add_months(month, -1))).alias(month)).distinct()
    return seen.where(F.abs(F.col("_x") - F.col("_xm")) / (MAD_SCALE * F.col("_xs")) > level_z).join(flagged, [*by, month], "left_semi").select(*by, month)


def null_out(df: DataFrame, bad: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same rows, with the values at ``bad`` set to null."""
    marked = df.join(bad.select(*keys).distinct().withColumn("_bad", F.lit(True)), keys, "left")
    return marked.withColumn(value, F.when(F.col("_bad").isNull(), F.col(value))).drop("_bad")


def combine_stations(df: DataFrame, by: list[str], station: str, time: str, value: str, raw: bool = False) -> DataFrame:
    """(by, time, value): the mean over stations; unless ``raw``, of what departs from each station's own mean, plus the
    mean of the stations' means, so that a station that starts or ends leaves no step."""
    if raw:
        return df.groupBy(*by, time).agg(F.avg(value).alias("value"))
    own = df.withColumn("_m", F.avg(value).over(Window.partitionBy(*by, station)))
    level = df.groupBy(*by, station).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias("_g"))
    return own.groupBy(*by, time).agg(F.avg(F.col(value) - F.col("_m")).alias("_a")).join(level, by).select(*by, time, (F.col("_a") + F.col("_g")).alias("value"))


def deseasonalise(df: DataFrame, by: list[str], season: str, value: str, train: str | None = "is_train", name: str | None = None) -> DataFrame:
    """Subtracts the mean of the value's season; the means come from training rows only (``train`` None: from all)."""
    x = F.col(value) if train is None else F.when(F.col(train), F.col(value))
    return df.withColumn(name or value, F.col(value) - F.avg(x).over(Window.partitionBy(*by, season)))
