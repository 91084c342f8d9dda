"""Whole analyses of causal edges: prepare panels, test every edge, adjust the family, keep results per edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar, clean, crossmap, edm, gaps, stats
from ..params import DEFAULT, Params
from ..sources.files import exists, remaining, require_complete, write_shards


def entity_panel(stations: DataFrame, drivers: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(entity, variable, month, pos, value, anomaly, is_train): cleaned and combined levels with their drivers.

    ``stations``: (entity, station, month, value); ``drivers``: (entity, month, variable, value). Drivers join on the
    level's calendar; anomalies use the training part's monthly means.
    """
    bad = clean.outliers(stations, ["entity", "station"], "month", "value", params.jump_z, params.level_z)
    level = clean.combine_stations(clean.null_out(stations, bad, ["entity", "station", "month"], "value"), ["entity"], "station", "month", "value")
    months = calendar.positions(calendar.densify(level, ["entity"], "month", "1 month"), ["entity"], "month")
    levels = months.select("entity", "month", "pos", F.lit("level").alias("variable"), "value")
    names = drivers.select("entity", "variable").distinct()
    others = months.select("entity", "month", "pos").join(names, "entity").join(drivers, ["entity", "month", "variable"], "left").select("entity", "month", "pos", "variable", "value")
    rows = calendar.train_flag(levels.unionByName(others), ["entity", "variable"], params.horizon).withColumn("season", F.month("month"))
    return clean.deseasonalise(rows, ["entity", "variable"], "season", "value", name="anomaly").drop("season")


def embedding_sizes(panel: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(entity, variable, size, tau, n_obs) by self-prediction of the training anomalies; under 30 values there is none."""
    train = panel.where("is_train")
    seen = train.groupBy("entity", "variable").agg(F.count("anomaly").alias("n_obs")).where("n_obs >= 30")
    kept = train.join(seen.select("entity", "variable"), ["entity", "variable"], "left_semi")
    skill = edm.simplex_skill(kept, ["entity", "variable"], "pos", "anomaly", list(params.dimensions), params.tau)
    sizes = edm.choose_size(skill, ["entity", "variable"])
    return seen.join(sizes, ["entity", "variable"], "left").select("entity", "variable", F.coalesce("size", F.lit(2)).alias("size"), F.lit(params.tau).alias("tau"), "n_obs")


def within_pairs(panel: DataFrame, sizes: DataFrame) -> DataFrame:
    """(entity, cause, effect, size, tau, pos, x, y) of every ordered pair of an entity's variables, training part."""
    train = panel.where("is_train")
    cause = train.select("entity", "pos", F.col("variable").alias("cause"), F.col("anomaly").alias("x"))
    effect = train.select("entity", "pos", F.col("variable").alias("effect"), F.col("anomaly").alias("y"))
    dims = sizes.select("entity", F.col("variable").alias("effect"), "size", "tau")
    return cause.join(effect, ["entity", "pos"]).where("cause <> effect").join(dims, ["entity", "effect"])


def between_pairs(panel: DataFrame, sizes: DataFrame, params: Params = DEFAULT, candidates: DataFrame | None = None) -> DataFrame:
    """(cause, effect, size, tau, pos, x, y) of levels of different entities on the union of their calendars.

    ``candidates`` (cause, effect) limits the pairs; without it every ordered pair is tested.
    """
    level = panel.where("variable = 'level'").select("entity", "month", F.col("anomaly").alias("value"))
    names = level.select("entity").distinct()
    if candidates is None:
        left, right = names.select(F.col("entity").alias("cause"), F.lit(1).alias("k")), names.select(F.col("entity").alias("effect"), F.lit(1).alias("k"))
        candidates = left.join(right, "k").where("cause <> effect").drop("k")
    pairs = candidates.select("cause", "effect")
    a = pairs.join(level.withColumnRenamed("entity", "cause"), "cause")
    b = pairs.join(level.withColumnRenamed("entity", "effect"), "effect")
    both = calendar.union_panel(a, b, "month", "1 month", ["cause", "effect"])
    rows = calendar.train_flag(calendar.positions(both, ["cause", "effect"], "month"), ["cause", "effect"], params.horizon).where("is_train")
    dims = sizes.where("variable = 'level'").select(F.col("entity").alias("effect"), "size", "tau")
    return rows.select("cause", "effect", "pos", F.col("value_a").alias("x"), F.col("value_b").alias("y")).join(dims, "effect").withColumn("scope", F.lit("between"))


def run(pairs: DataFrame, by: list[str], store: str | None = None, params: Params = DEFAULT) -> DataFrame:
    """Edges with evidence. With ``store`` each result is kept as it comes, finished edges are left out of the next run,
    and the family is adjusted only when it is complete."""
    keys = [*by, "cause", "effect"]
    if not store:
        return stats.causal_evidence(crossmap.edge_tests(pairs, by, "pos", params))
    spark, todo = pairs.sparkSession, pairs.select(*keys).distinct()
    left = todo
    if exists(spark, store):
        left = remaining(todo, spark.read.parquet(store), keys)
    write_shards(crossmap.edge_tests(pairs.join(left, keys, "left_semi"), by, "pos", params), store, by)
    return stats.causal_evidence(require_complete(todo, spark.read.parquet(store), keys))


def usable_variables(panel: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Rows of variables whose training part has no gap of more than ``max_gap`` steps."""
    return gaps.without_long_gaps(panel, ["entity", "variable"], "pos", "value", params.max_gap)
