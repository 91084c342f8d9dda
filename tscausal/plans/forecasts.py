"""A whole forecast comparison: predictors from the causal graph, all configurations, errors and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edm, forecast, selection, stats
from ..params import DEFAULT, Params
from ..sources.files import durable, exists, remaining, require_complete, write_shards


def wide(panel: DataFrame, variables: list[str]) -> DataFrame:
    """(entity, pos, level, …) of anomalies."""
    return panel.groupBy("entity", "pos").pivot("variable", variables).agg(F.first("anomaly"))


def lag_scans(panel: DataFrame, variables: list[str], sizes: DataFrame, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Best lags (entity, variable, lag) of each variable for the level, from lags 1..12 and from the full scan.

    The embedding has one size per level; sizes differ between entities, so each size is scanned for its entities.
    """
    rows = wide(panel.where("is_train"), ["level", *variables])
    dims = sizes.where("variable = 'level'").select("entity", "size")
    out = []
    for lags in (list(params.forecast_lags), list(params.lags)):
        found = None
        for size in params.dimensions:
            mine = rows.join(dims.where(F.col("size") == size).select("entity"), "entity", "left_semi")
            for v in variables:
                best = edm.best_lag(edm.cross_map(mine, ["entity"], "pos", v, "level", lags, size, params.tau, least=0), ["entity"], 1)
                part = best.select("entity", F.lit(v).alias("variable"), F.col("lag").cast("int").alias("lag"))
                found = part if found is None else found.union(part)
        out.append(durable(found))
    return out[0], out[1]


def _results(table: DataFrame, methods: DataFrame, drivers: list[str], shape: tuple, store: str | None, params: Params) -> DataFrame:
    """Forecasts of all methods, with ``store`` one shard for each entity."""
    fit = lambda rows: forecast.run_methods(rows, methods, ["entity"], "pos", "level", drivers, shape, params)
    if not store:
        return durable(fit(table))
    spark, todo = table.sparkSession, table.select("entity").distinct()
    left = remaining(todo, spark.read.parquet(store), ["entity"]) if exists(spark, store) else todo
    left = durable(left)
    if not left.isEmpty():
        write_shards(fit(table.join(left, "entity", "left_semi")), store, ["entity"])
    return require_complete(todo, spark.read.parquet(store), ["entity"])


def run(panel: DataFrame, edges: DataFrame, sizes: DataFrame, drivers: list[str], neighbours: DataFrame | None = None, store: str | None = None, params: Params = DEFAULT) -> dict[str, DataFrame]:
    """selected, results, metrics and tests of all configurations; the tree shape is chosen once for all entities.

    With ``store`` the forecasts of an entity are kept as they come, and finished entities are left out of the next run.
    """
    table = durable(wide(panel, ["level", *drivers]))
    train = table.join(panel.where("is_train AND variable = 'level'").select("entity", "pos"), ["entity", "pos"], "left_semi")
    ahead, full = lag_scans(panel, drivers, sizes, params)
    everything = stats.pearson_by_lag(train, ["entity"], "pos", drivers, "level", list(params.forecast_lags)).select("entity", "variable", F.col("lag").cast("int").alias("lag"))
    direct = selection.direct_lags(edges, ["entity"], "level", ahead)
    ancestors = selection.ancestor_lags(edges, ["entity"], "level", ahead, full, sizes)
    step = selection.stepwise_lags(train, ["entity"], "pos", "level", everything)
    sets = {"all": everything, "stepwise": step, "causal_direct": direct.select("entity", "variable", "lag"), "causal_ancestors": ancestors.select("entity", "variable", "lag")}
    if neighbours is not None:  # (entity, variable, lag), with the neighbours' levels among ``drivers``
        sets["causal_neighbours"] = sets["causal_ancestors"].union(neighbours).join(neighbours.select("entity").distinct(), "entity", "left_semi")
    methods = forecast.method_matrix(table, ["entity"], sets)
    shape = forecast.chosen_shape(forecast.tune_trees(table, ["entity"], "pos", "level", params), params)
    results = _results(table, methods, drivers, shape, store, params)
    return {
        "selected": forecast.foresight(methods, params),
        "results": results,
        "metrics": stats.forecast_metrics(results.where("status = 'ok'"), ["entity", "method", "horizon"]),
        "tests": forecast.accuracy_battery(results, ["entity"]),
    }
